"""Dense order numbers and streamed folds for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netquarry.llm.textkit import small_batches
from netquarry.session import stage

#: Row numbers of a task stand in the lower bits of ``monotonically_increasing_id``.
TASK_BITS = 33


def _changes(keys: pa.Array, before) -> pa.Array:
    """Whether each key differs from the one before it; null for the first row of all."""
    same = pc.equal(keys[1:], keys[:-1])
    nulls = pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1]))
    inner = pc.invert(pc.if_else(pc.is_null(same), nulls, same))
    first = None if before is None else before[0] != keys[0].as_py()
    return pa.concat_arrays([pa.array([first], pa.bool_()), inner.cast(pa.bool_())])


def in_order(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows, stored, with ``_at`` (dense from 0 over the whole table) and ``_first`` (of its group).

    Rows are sorted by group, then by ``order``, nulls first. The sort is
    dealt by ranges of all of these and a row number, so neither a hot group
    nor a hot group of equal rows lands in one task, and no window is needed:
    a row's number is its place in its task plus the rows of all tasks before.
    Only one line per task reaches the driver.
    """
    keys: list[Column] = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    small_batches(dealt)
    placed = dealt.withColumn("_place", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

    def mark(batches):
        before = None
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(group)
                yield batch.append_column("_fresh", _changes(keys, before))
                before = (keys[-1].as_py(),)

    stored = stage(placed.mapInArrow(mark, fields + ", _fresh boolean"), name)
    task = F.shiftright("_place", TASK_BITS)
    ends = stored.groupBy(task.alias("task")).agg(
        F.count("*").alias("n"), F.min_by(group, "_place").alias("lo"), F.max_by(group, "_place").alias("hi")
    )
    lines, at, before = [], 0, None
    for line in ends.orderBy("task").collect():  # one line per task of the sort
        lines.append((line["task"], at, before is None or before[0] != line["lo"]))
        at, before = at + line["n"], (line["hi"],)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(lines, "_task long, _offset long, _starts boolean"))
    return stored.join(offsets, task == F.col("_task")).select(
        *rows.columns,
        (F.col("_offset") + F.col("_place").bitwiseAND((1 << TASK_BITS) - 1)).alias("_at"),
        F.coalesce("_fresh", "_starts").alias("_first"),
    )


def fold_runs(
    rows: DataFrame, key: Sequence[str], order: Sequence[Column], start: Callable, schema: str
) -> DataFrame:
    """Fold every group's rows in order, one row in memory at a time.

    ``start(key)`` gives an object with ``add(row)``, which returns output
    tuples or None, and ``done()``, which does so too at the group's end. The
    rows of a group pass through one task, as an ordered fold (a digest, a
    chain of states) demands, but as a sorted stream that spills, not as a list.
    """
    dealt = rows.repartition(*key).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in key], *order)
    small_batches(dealt)
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], target.names)

    def run(batches):
        current, fold = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in key)
                if own != current:
                    if fold:
                        out += fold.done() or ()
                    current, fold = own, start(own)
                out += fold.add(row) or ()
            if out:
                yield table(out)
        if fold and (out := list(fold.done() or ())):
            yield table(out)

    return dealt.mapInArrow(run, schema)
