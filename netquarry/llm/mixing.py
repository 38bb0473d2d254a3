"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree of levels (domain, language, source). A token budget
flows from the root: every node shares its budget among its children by
weight, and no child gets more than its subtree can give (its tokens times
the epochs allowed). What a full child can't take goes to its siblings by
weight; as a subtree's capacity is the sum of its leaves', a shortage is met
among siblings before anything reaches an ancestor's other children.

A leaf's budget is read from seeded epochs: each epoch is the leaf's
documents in the order of a hash of seed, epoch and id, and the budget is a
token prefix of the epochs laid end to end: whole epochs, then the documents
of the last one until the budget is met; the last document counts as a whole.

The tree has one row per leaf and its shares are windows over siblings.
Documents meet an order only in the range of the hash where a leaf's prefix
ends; ranges are as many as the leaf's rows need, and those before and after
are taken or left whole.

Null levels are a value of their own; a null id is ordered as an empty one;
null texts have no tokens, and are taken while their leaf's prefix lasts (a
leaf without any token is taken once).
Repeated rows are taken or left together and their tokens count each time.
Without weights all children of a node weigh the same; a child that its
level's weights don't name, null among them, weighs ``unnamed``. Weights that
are null, zero or negative count as 0, and such a child gets nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.session import stage


@dataclass(frozen=True)
class MixConfig:
    """budget: tokens wanted, as a share of those there are; epochs: how often a document may be taken;
    unnamed: the weight of children that a level's weights don't name."""

    budget: float = 1.0
    epochs: int = 2
    seed: int = 17
    run_rows: int = 20_000
    unnamed: float = 0.05


def count_tokens(text: Column) -> Column:
    """Words of a text; each counts as a token."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def share_out(leaves: DataFrame, levels: Sequence[str], budget: Column) -> DataFrame:
    """Adds ``budget`` (whole tokens) to leaves with a ``capacity`` and weights ``w_<level>`` per level."""
    capacity = [F.sum("capacity").over(Window.partitionBy(*levels[: i + 1])) for i in range(len(levels))]
    tree = leaves.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(capacity)])
    given = tree.withColumn("_b", F.least(budget.cast("double"), F.sum("capacity").over(Window.partitionBy(F.lit(0))).cast("double")))
    for i, level in enumerate(levels):
        parent, weight, room = list(levels[:i]), F.col(f"w_{level}"), F.col(f"_c{i}").cast("double")
        # one row per child, fullest first: a child is full if its room is under its share of what is left
        children = given.select(*levels[: i + 1], "_b", weight.alias("_w"), room.alias("_c")).distinct()
        order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("_c") / F.when(F.col("_w") > 0, F.col("_w")), *levels[: i + 1])
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        some = children.where("_w > 0")
        level_rows = some.select(
            "*",
            ((F.col("_b") - F.coalesce(F.sum("_c").over(before), F.lit(0.0))) / F.sum("_w").over(after)).alias("_rate"),
        ).withColumn("_open", F.when(F.col("_c") > F.col("_rate") * F.col("_w"), F.col("_rate")))
        rate = F.first("_open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        shares = level_rows.withColumn("_open", rate).select(
            *[F.col(c).alias(f"_k{j}") for j, c in enumerate(levels[: i + 1])],
            F.when(F.col("_open").isNull(), F.col("_c")).otherwise(F.least(F.col("_c"), F.col("_open") * F.col("_w"))).alias("_share"),
        )
        same = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(levels[: i + 1])]
        on = same[0]
        for other in same[1:]:
            on = on & other
        given = given.join(shares, on, "left").withColumn("_b", F.coalesce("_share", F.lit(0.0))).drop("_share", *[f"_k{j}" for j in range(i + 1)])
    # a double's last digit must not make a full leaf miss a token
    return given.withColumn("budget", F.floor(F.col("_b") + 1e-6).cast("bigint")).drop("_b", *[f"_c{i}" for i in range(len(levels))])


def epoch_key(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame, levels: Sequence[str], weights: dict[str, DataFrame] | None = None, cfg: MixConfig = MixConfig(),
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): rows are (id, levels, tokens, copies) of all documents, leaves the budgets.

    ``weights`` has for a level a table of its value and ``weight``. ``copies``
    says in how many epochs a document is taken, 0 if in none.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    rows = stage(
        docs.select(
            docs[id_col].alias("_id"), *[docs[c].cast("string").alias(n) for c, n in zip(levels, names)],
            count_tokens(docs[text_col]).alias("_tokens"),
        ),
        "mix-rows",
    )
    sums = stage(rows.groupBy(*names).agg(F.sum("_tokens").alias("available"), F.count("*").alias("n_docs")), "mix-leaves")
    wanted = int((sums.agg(F.sum("available")).first()[0] or 0) * cfg.budget)
    leaves = sums.withColumn("capacity", F.col("available") * cfg.epochs)
    for level, name in zip(levels, names):
        given = (weights or {}).get(level)
        if given is None:
            leaves = leaves.withColumn(f"w_{name}", F.lit(1.0))
        else:
            weight = F.greatest(F.coalesce(given["weight"].cast("double"), F.lit(0.0)), F.lit(0.0))
            table = given.groupBy(given[level].cast("string").alias("_value")).agg(F.max(weight).alias(f"w_{name}"))
            leaves = leaves.join(table, leaves[name].eqNullSafe(table["_value"]), "left").drop("_value")
            leaves = leaves.withColumn(f"w_{name}", F.coalesce(f"w_{name}", F.lit(float(cfg.unnamed))))
    budgets = stage(share_out(leaves, names, F.lit(wanted)), "mix-budgets")
    plan = budgets.select(
        *[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], "n_docs",
        F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(1).cast("int").alias("_whole"),
        F.when(F.col("available") > 0, F.col("budget") % F.col("available")).otherwise(0).cast("bigint").alias("_rest"),
    )
    on = F.lit(True)
    for i, n in enumerate(names):
        on = on & F.col(n).eqNullSafe(F.col(f"_k{i}"))
    digits = F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / cfg.run_rows) / 4))).cast("int")
    keyed = (
        rows.join(plan, on).drop(*[f"_k{i}" for i in range(len(names))])
        .withColumn("_key", epoch_key(cfg.seed, F.col("_whole"), F.col("_id"))).withColumn("_run", F.substr("_key", F.lit(1), digits))
    )
    runs = keyed.groupBy(*names, "_run").agg(F.sum("_tokens").alias("_sum"))
    order = Window.partitionBy(*names).orderBy("_run")
    starts = runs.withColumn("_start", F.sum("_sum").over(order) - F.col("_sum"))
    begin = starts.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], F.col("_run").alias("_krun"), "_start", "_sum")
    placed = keyed.join(begin, on & (F.col("_run") == F.col("_krun"))).drop(*[f"_k{i}" for i in range(len(names))], "_krun")
    last = (F.col("_start") < F.col("_rest")) & (F.col("_start") + F.col("_sum") > F.col("_rest"))
    edge = placed.where(last).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_tokens").over(
        Window.partitionBy(*names, "_run").orderBy("_key")) - F.sum("_tokens").over(Window.partitionBy(*names, "_run", "_key")), F.lit(0)))
    others = placed.where(~last).withColumn("_before", F.col("_start"))
    taken = edge.unionByName(others).select(
        F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, levels)], F.col("_tokens").alias("tokens"),
        (F.col("_whole") + F.when(F.col("_before") < F.col("_rest"), 1).otherwise(0)).cast("int").alias("copies"),
    )
    leaves_out = budgets.select(*[F.col(n).alias(c) for n, c in zip(names, levels)], "n_docs", "available", "budget")
    return taken, leaves_out
