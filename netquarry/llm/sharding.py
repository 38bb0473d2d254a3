"""Hilbert-curve sharding for multidimensional file pruning.

Metadata dimensions are quantised to equally filled cells, every cell gets its
index on the Hilbert curve, rows are ordered by (curve index, hash of the id)
and the order is cut into runs of equal row counts (law ``rows``). A shard
then covers few values of every dimension, so that filters on any of them
skip most files.

Strings are quantised by the six bytes that follow their common beginning,
read as a number, which keeps their order. Ranks are global yet no window
spans a large group: rows are counted in runs of one cell and one range of
the hash, so many that a run holds ``run_rows`` rows at most on average, a
hot cell as well; the runs' places come from sums over the counts.

Null dimensions lie in the lowest cell and a null text counts as empty. A row
that occurs several times fills several slots; rows that agree in id and text
are interchangeable. An empty table has no shards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.session import stage


MOST_BITS = 16


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 16
    bits: int = 4
    run_rows: int = 20_000


def _code(column: Column, kind: str, lowest: Column, highest: Column) -> Column:
    """An order-keeping number for a value; ``lowest`` and ``highest`` are those of the table."""
    if kind != "string":
        return column.cast("double")
    low, high = F.coalesce(lowest, F.lit("")).cast("binary"), F.coalesce(highest, F.lit("")).cast("binary")
    a, b = F.hex(low), F.hex(high)
    same = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) + 1), F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(n),
    )
    skip = F.least(F.length(a), same - same % 2)
    tail = F.substr(F.hex(column.cast("binary")), skip + 1, F.lit(12))
    return F.conv(F.rpad(tail, 12, "0"), 16, 10).cast("double")


def curve_index(axes: Sequence[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve (Skilling's transform), from its coordinates."""
    n = len(axes)
    state = F.array(*[a.cast("int") for a in axes])

    def at(x: Column, i: int) -> Column:
        return F.element_at(x, i + 1)

    def exchange(x: Column, i: int, q: Column) -> Column:
        """Invert the low bits of axis 0 where axis i has the bit, else swap them with axis i's."""
        low = q - 1
        first, other = at(x, 0), at(x, i)
        t = first.bitwiseXOR(other).bitwiseAND(low)
        turned = other.bitwiseAND(q) != 0
        values = [at(x, j) for j in range(n)]
        values[0] = F.when(turned, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(t))
        if i:
            values[i] = F.when(turned, other).otherwise(other.bitwiseXOR(t))
        else:
            values[0] = F.when(turned, first.bitwiseXOR(low)).otherwise(first)
        return F.array(*values)

    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        out = exchange(x, 0, s["q"])
        for i in range(1, n):
            out = F.when(s["i"] == i, exchange(x, i, s["q"])).otherwise(out)
        return out

    turned = F.aggregate(steps, state, step)
    gray = F.aggregate(
        F.sequence(F.lit(2), F.lit(n)), turned,
        lambda x, k: F.transform(x, lambda v, j: F.when(j == k - 1, v.bitwiseXOR(F.element_at(x, k - 1))).otherwise(v)),
    ) if n > 1 else turned
    flips = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0),
        lambda t, q: F.when(F.element_at(gray, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    ) if bits > 1 else F.lit(0)
    digits = F.transform(gray, lambda v: v.bitwiseXOR(flips))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.aggregate(
        places, F.lit(0).cast("bigint"),
        lambda h, p: h * 2 + F.call_function("shiftright", F.element_at(digits, p["i"] + 1), p["b"]).bitwiseAND(1).cast("bigint"),
    )


def with_curve(docs: DataFrame, dims: Sequence[str], bits: int, out: str = "_curve") -> DataFrame:
    """Adds the curve index of each row's cell; the cells' bounds are quantiles over all rows."""
    if bits * len(dims) > MOST_BITS:
        raise ValueError(f"bits x dimensions must be {MOST_BITS} at most: the table of cells is broadcast")
    kinds = {c: docs.schema[c].dataType.simpleString() for c in dims}
    ends = docs.agg(*[f(F.col(c)).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max)]).first()
    codes = [_code(F.col(c), kinds[c], F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"])) for c in dims]
    cells = 1 << bits
    cuts = docs.agg(*[F.percentile_approx(code, [i / cells for i in range(1, cells)], 10_000).alias(f"_{i}") for i, code in enumerate(codes)]).first()

    def axis(code: Column, bounds: list[float] | None) -> Column:
        if not bounds:
            return F.lit(0)
        return F.coalesce(F.when(code.isNotNull(), F.size(F.filter(F.lit([float(x) for x in bounds]), lambda b: b < code))), F.lit(0))

    axes = [axis(code, cuts[i]) for i, code in enumerate(codes)]
    names = [f"_axis{i}" for i in range(len(dims))]
    placed = docs.select("*", *[a.alias(n) for a, n in zip(axes, names)])
    every = docs.sparkSession.range(1 << (bits * len(dims))).select(
        *[F.call_function("shiftright", F.col("id"), F.lit(bits * i)).bitwiseAND(cells - 1).cast("int").alias(n) for i, n in enumerate(names)]
    )
    curve = every.select(*names, curve_index([F.col(n) for n in names], bits).alias(out))
    return placed.join(F.broadcast(curve), names).drop(*names)  # 2 ** (bits x dimensions) rows


def with_rank(rows: DataFrame, order: str, key: Column, run_rows: int) -> DataFrame:
    """Adds ``_rank`` from 0 over (``order``, ``key``) and ``_total``; ``key`` is a 64-bit hash.

    ``rows`` should be a stored table, as it is read twice. ``order`` has few
    values (cells of the curve); their sizes are broadcast, so that rows are
    dealt by run and never by the value alone.
    """
    keyed = rows.withColumn("_key", key)
    sizes = keyed.groupBy(order).agg(F.count("*").alias("_n"))
    # runs of one order value: by the highest bits of the key, as many as its rows need
    split = sizes.select(order, F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / run_rows))).cast("int").alias("_bits"))
    run = F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", F.col("_key").bitwiseXOR(F.lit(-(2**63))), F.lit(1)), F.lit(63) - F.col("_bits"))
    runs = keyed.join(F.broadcast(split), order).withColumn("_run", run).drop("_bits")
    counts = runs.groupBy(order, "_run").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(order).orderBy("_run")
    before = Window.orderBy(order)
    starts = (
        counts.withColumn("_inner", F.sum("_n").over(within) - F.col("_n"))
        .join(sizes.withColumn("_outer", F.sum("_n").over(before) - F.col("_n")).drop("_n"), order)
        .select(order, "_run", (F.col("_outer") + F.col("_inner")).alias("_start"))
    )
    place = Window.partitionBy(order, "_run").orderBy("_key", *[c for c in rows.columns if c != order])
    ranked = runs.withColumn("_place", F.row_number().over(place)).join(starts, [order, "_run"])
    return (
        ranked.withColumn("_rank", F.col("_start") + F.col("_place") - 1).withColumn("_total", F.lit(rows.count()))
        .drop("_start", "_place", "_run", "_key")
    )


def hilbert_shards(
    docs: DataFrame, dims: Sequence[str] = ("lang", "source", "n_chars"), cfg: ShardConfig = ShardConfig(),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot) of every row; sizes of shards differ by one row at most."""
    text = F.coalesce(docs[text_col], F.lit(""))
    narrow = docs.select(
        docs[id_col].alias("_id"), (F.octet_length(text) + 1).cast("bigint").alias("_size"), F.crc32(text).alias("_crc"),
        *[docs[c].alias(f"_dim{i}") for i, c in enumerate(dims)],
    )
    names = [f"_dim{i}" for i in range(len(dims))]
    placed = with_curve(stage(narrow, "shard-rows"), names, cfg.bits).drop(*names)
    ranked = with_rank(stage(placed, "shard-curve"), "_curve", F.xxhash64("_id"), cfg.run_rows)
    exact = F.expr(f"(_rank * {cfg.shards}) div _total")
    first = F.expr(f"(_shard * _total + {cfg.shards} - 1) div {cfg.shards}")
    return ranked.withColumn("_shard", exact).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_curve").alias("curve"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"),
    )


def digest(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return sharded.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
