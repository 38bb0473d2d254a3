"""Aggregation shapes used by many operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_values(df: DataFrame, keys: Sequence[str], value: str, out: str, n: int | None = None) -> DataFrame:
    """The distinct values per key as a sorted array; with ``n`` the first ones only.

    De-duplicates with a combining aggregate first; with ``n`` the rank filter
    then becomes a per-partition group limit.
    """
    rows = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    if n is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))


def smallest_values(df: DataFrame, keys: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """The ``n`` smallest distinct values per key as a sorted array."""
    return sorted_values(df, keys, value, out, n)


# Spark cuts groups before the shuffle only for ranks up to this many rows
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 64


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", salted: bool | None = None
) -> DataFrame:
    """The first ``n`` rows per key in the given (full) order.

    Up to ``GROUP_LIMIT`` rows Spark limits each group before the shuffle. For
    more, a first rank inside salted parts of each group does the same, so one
    task never sorts a whole hot group.
    """
    rows = df
    if n > GROUP_LIMIT if salted is None else salted:
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = df.withColumn("_salt", part).withColumn("_part", F.row_number().over(inner))
        rows = rows.where(F.col("_part") <= n).drop("_salt", "_part")
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order (ties need a full order)."""
    return top_rows(df, keys, order, 1, "_first").drop("_first")


def latest(value: str, ts: str = "timestamp") -> Column:
    """Last non-null value by event time; ties go to the greater value."""
    v = F.col(value)
    return F.max(F.when(v.isNotNull(), F.struct(F.col(ts).alias("t"), v.alias("v")))).getField("v")


def earliest(value: str, ts: str = "timestamp") -> Column:
    """First non-null value by event time; ties go to the lesser value."""
    v = F.col(value)
    return F.min(F.when(v.isNotNull(), F.struct(F.col(ts).alias("t"), v.alias("v")))).getField("v")


def left_join_all(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join several one-row-per-key frames; null keys match each other."""
    out = base
    for i, part in enumerate(parts):
        renamed = part.select(
            *[F.col(k).alias(f"_k{i}_{k}") for k in keys],
            *[c for c in part.columns if c not in keys],
        )
        cond = None
        for k in keys:
            eq = F.col(k).eqNullSafe(F.col(f"_k{i}_{k}"))
            cond = eq if cond is None else cond & eq
        out = out.join(renamed, cond, "left").drop(*[f"_k{i}_{k}" for k in keys])
    return out


#: Bits of a prefilter's bitmap per key, and at most (16 MB).
BITS_PER_KEY = 32
MOST_BITS = 27


def bitmap_pieces(places: DataFrame) -> DataFrame:
    """(_piece, _bits): the bitmap of the places (_bit) in pieces of 512 bits.

    A join copies the whole value it finds to every row, so Spark's bitmaps of 32,768 bits are cut.
    """
    at = F.col("_bit") + 1
    bucket, bit = F.call_function("bitmap_bucket_number", at), F.call_function("bitmap_bit_position", at)
    maps = places.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(
        F.call_function("bitmap_construct_agg", F.col("_bit")).alias("_map")
    )
    pieces = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substr("_map", i * 64 + 1, F.lit(64)))
    return maps.select("_bucket", F.posexplode(pieces).alias("_i", "_bits")).select(((F.col("_bucket") - 1) * 64 + F.col("_i")).alias("_piece"), "_bits")


def possible_rows(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys may be among ``wanted`` (stored; one row per key): all that are, few others.

    A bitmap over hashes of the wanted keys, sized by their number, is
    broadcast and tested in the scan's stage, before anything is shuffled.
    Beyond some four million keys more and more other rows pass.
    """
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(BITS_PER_KEY * (wanted.count() + 1)))))
    at = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    maps = bitmap_pieces(wanted.select(at.alias("_bit")))
    marked = rows.withColumn("_hash", at).withColumns({"_own": F.shiftright("_hash", 9), "_at": (F.col("_hash") % 512).cast("int")})
    marked = marked.join(F.broadcast(maps), F.col("_own") == F.col("_piece"))
    byte = F.conv(F.hex(F.substr("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")).bitwiseAND(1) == 1
    return marked.where(is_set).select(*rows.columns)


#: Rows that a key's time bucket should have, and a task that orders them.
BUCKET_ROWS = 100_000
TASK_ROWS = 500_000


def key_sizes(df: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """(n, lo, hi): rows, first and last time of each key."""
    return df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi")).select("n", "lo", "hi")


def interarrival(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    bucket_seconds: int = 3600,
    keep_zero: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Row count, gap count, mean and population deviation of the gaps between
    consecutive events of a key.

    One key may hold a third of all rows, so the ordering runs per (key, time
    bucket); bucket summaries are then stitched with the gap between one
    bucket's last and the next bucket's first event, and the moments combined
    around the common mean (no cancellation, result independent of bucketing).

    Buckets are ``bucket_seconds`` long at least. Where keys are sparse they
    are longer, so that the summaries are few, and the more rows there are the
    more tasks order them: one pass finds both (``sizes`` of a stored summary
    spares it).
    """
    keys = list(keys)
    sizes = key_sizes(df, keys, ts) if sizes is None else sizes
    span = (F.unix_micros("hi") - F.unix_micros("lo") + 1) / F.ceil(F.col("n") / BUCKET_ROWS)
    width = F.min(F.when(F.col("n") > BUCKET_ROWS, span))
    extent = F.max(F.unix_micros("hi")) - F.min(F.unix_micros("lo")) + 1
    found = sizes.agg(F.sum("n").alias("n"), F.coalesce(width, extent).cast("bigint").alias("width")).first()
    micros = max(bucket_seconds * 1_000_000, found["width"] or 0)
    rows = df.where(F.col(ts).isNotNull()).select(*keys, F.unix_micros(F.col(ts)).alias("_us"))
    rows = rows.withColumn("_b", F.floor(F.col("_us") / F.lit(micros)))
    tasks = math.ceil((found["n"] or 0) / TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, *keys, "_b")
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_us")
    gap = (F.col("_us") - F.lag("_us").over(in_bucket)) / F.lit(1_000_000.0)
    rows = rows.withColumn("_gap", gap)
    if not keep_zero:
        rows = rows.withColumn("_gap", F.when(F.col("_gap") > 0, F.col("_gap")))
    parts = rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_gap").alias("_n"),
        F.avg("_gap").alias("_mean"),
        F.var_pop("_gap").alias("_var"),
        F.min("_us").alias("_lo"),
        F.max("_us").alias("_hi"),
    )
    across = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    stitch = (F.col("_lo") - F.lag("_hi").over(across)) / F.lit(1_000_000.0)
    parts = parts.withColumn("_stitch", stitch)
    weight = F.col("_n") + F.when(F.col("_stitch").isNotNull(), 1).otherwise(0)
    total = F.coalesce(F.col("_n") * F.col("_mean"), F.lit(0.0)) + F.coalesce(F.col("_stitch"), F.lit(0.0))
    parts = parts.withColumn("_mu", F.sum(total).over(whole) / F.nullif(F.sum(weight).over(whole), F.lit(0)))
    mu = F.col("_mu")
    spread = F.coalesce(
        F.col("_n") * (F.col("_var") + (F.col("_mean") - mu) * (F.col("_mean") - mu)), F.lit(0.0)
    ) + F.coalesce((F.col("_stitch") - mu) * (F.col("_stitch") - mu), F.lit(0.0))
    return parts.groupBy(*keys).agg(
        F.sum("_rows").alias("events"),
        F.sum(weight).alias("gaps"),
        F.max("_mu").alias("mean_interval"),
        F.sqrt(F.sum(spread) / F.nullif(F.sum(weight), F.lit(0))).alias("std_dev"),
    )


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str, seconds: Column, bucket_seconds: int = 600
) -> DataFrame:
    """Attach the fields of the next row of the same key as a struct, null at
    the end. The order runs inside time buckets; the last row of a bucket gets
    the first row of the key's next bucket, so a hot key is split by time."""
    keys = list(keys)
    rows = df.withColumn("_b", F.floor(seconds / bucket_seconds))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = rows.withColumn(out, F.lead(F.struct(*fields)).over(inside))
    first = rows.groupBy(*keys, "_b").agg(F.min(F.struct(*order, F.struct(*fields).alias("_f"))).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_b")
    nexts = first.withColumn("_next", F.lead("_first").over(across).getField("_f")).drop("_first")
    joined = left_join_all(rows, [nexts], [*keys, "_b"])
    return joined.withColumn(out, F.coalesce(out, "_next")).drop("_b", "_next")


def substring_matches(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = 6) -> DataFrame:
    """Distinct (text, needle) pairs where the text contains the needle.

    An equi-join instead of a nested loop: every run of ``n`` characters (n =
    min(gram, length)) of a contained needle is one of the text's n-grams, so
    rows meet on (n, gram) and the containment test only filters candidates.
    Of a needle's runs the one that fewest needles have is taken, so that
    needles with a common beginning do not all meet the same texts. Texts are
    cut only to the (at most ``gram``) sizes that needles have.
    """
    n = F.least(F.length(needle), F.lit(gram))
    runs = (
        needles.select(needle).where(F.length(needle) > 0).distinct().select(needle, n.alias("_n"))
        .select(needle, "_n", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length(needle) - F.col("_n") + 1), lambda i: F.substring(F.col(needle), i, F.col("_n"))
        ))).alias("_gram"))
    )
    shared = runs.groupBy("_n", "_gram").agg(F.count(F.lit(1)).alias("_needles"))
    keyed = (
        runs.join(shared, ["_n", "_gram"]).groupBy(needle, "_n").agg(F.min(F.struct("_needles", "_gram")).alias("_best"))
        .select(needle, "_n", F.col("_best._gram").alias("_gram"))
    )
    sizes = needles.where(F.length(needle) > 0).select(n.alias("_n")).distinct()
    grams = (
        texts.select(text).where(F.length(text) > 0).distinct()
        .join(F.broadcast(sizes), F.col("_n") <= F.length(text))
        .select(
            text, "_n",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1),
                        lambda i: F.substring(F.col(text), i, F.col("_n")),
                    )
                )
            ).alias("_gram"),
        )
    )
    return grams.join(keyed, ["_n", "_gram"]).where(F.contains(F.col(text), F.col(needle))).select(text, needle)


def first_listed_match(df: DataFrame, text: str, needles: DataFrame, out: str) -> DataFrame:
    """Attach the list entry (needle, ordinal) with the lowest position that the
    text contains; null when none does."""
    pairs = substring_matches(df, text, needles, "needle").join(needles, "needle")
    best = pairs.groupBy(text).agg(F.min(F.struct("ordinal", "needle")).getField("needle").alias(out))
    return df.join(best, text, "left")
