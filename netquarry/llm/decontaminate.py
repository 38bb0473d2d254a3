"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (ten words in a row, or the whole of a shorter item) must
be found word for word in a document. A window is the ordered list of its
shingles. As all of them have to be there, its rarest shingle is the one
necessary prefix token: shingles are ordered by how often they stand in the
documents, and only occurrences of a window's rarest one are joined with it.
The join fixes where the window would begin; it must begin within the
document and end before the document does (positional and length bounds), and
what remains is compared word for word.

Documents are scanned once for occurrences of benchmark shingles, which are
hashes here and so a superset of the true ones; an occurrence carries the few
words around it that any window through it could have, so texts are neither
shuffled nor read again. The shingles are broadcast in blocks of a bounded
size; a benchmark with more of them than one block takes a scan per block.

A null text has no words; a window without words does not exist. Rows that
agree in id and text get equal results, one each; a repeated item id stands
for all its texts; an item without an id hits but is not named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.semijoin import without
from netquarry.session import stage

#: All ASCII but digits and letters parts words.
BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = 0  # stands for a document itself among the shingles


@dataclass(frozen=True)
class LeakConfig:
    window: int = 10
    shingle: int = 3
    block_rows: int = 2_000_000


def words_of(text: Column) -> Column:
    """The words with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def _rough_hashes(words: Column) -> Column:
    """Hashes of words, all letters lower-cased: equal words have equal hashes, a few others too."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _shingles(hashes: Column, size: int) -> Column:
    """A hash for the run of ``size`` words that begins at each word; a rest shorter than that as well."""
    return F.transform(hashes, lambda h, i: F.xxhash64(F.lit(size), h, *[F.get(hashes, i + k) for k in range(1, size)]))


def item_windows(benchmark: DataFrame, cfg: LeakConfig, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, size): the distinct windows of each item, as space-joined words."""
    words = benchmark.select(benchmark[id_col].cast("string").alias("item"), words_of(benchmark[text_col]).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - cfg.window + 1))
    return words.select("item", "w", F.explode(starts).alias("at")).select(
        "item", F.slice("w", F.col("at"), cfg.window).alias("s")
    ).select("item", F.array_join("s", " ").alias("window"), F.size("s").alias("size")).distinct()


def window_tokens(windows: DataFrame, cfg: LeakConfig) -> DataFrame:
    """(window, size, offset, token, part): the shingles of each distinct window, ``part`` words long."""
    part = F.least(F.col("size"), F.lit(cfg.shingle))
    hashes = windows.select("window", "size", part.alias("part")).distinct().withColumn("h", _rough_hashes(F.split("window", " ")))
    by_size = None
    for size in range(1, cfg.shingle + 1):
        own = hashes.where(F.col("part") == size).select("window", "size", F.posexplode(_shingles(F.col("h"), size)).alias("offset", "token"))
        own = own.where(F.col("offset") <= F.col("size") - size).withColumn("part", F.lit(size))
        by_size = own if by_size is None else by_size.unionByName(own)
    return by_size


def occurrences(docs: DataFrame, tokens: DataFrame, cfg: LeakConfig) -> DataFrame:
    """(id, text_key, n_words, token, at, lead, around) of the listed shingles in all documents.

    ``around`` are the words from ``lead`` words before the shingle on, up to
    a window's length behind it. Every document also has one row with
    ``at`` -1.
    """
    sizes = sorted(r[0] for r in tokens.select("part").distinct().collect())  # cfg.shingle values at most
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAKS), "")
    hashed = docs.select("id", "text_key", words.alias("w")).withColumn("h", _rough_hashes(F.col("w")))
    # each size has its own stretch of n_words places behind the document's own
    hashes = F.concat(F.array(F.lit(ROW).cast("bigint")), *[_shingles(F.col("h"), size) for size in sizes])
    found = hashed.select("id", "text_key", "w", F.size("w").alias("n_words"), F.posexplode(hashes).alias("place", "token"))
    at = F.when(F.col("token") == ROW, F.lit(-1)).otherwise((F.col("place") - 1) % F.col("n_words"))
    lead = F.when(F.col("at") < 0, F.lit(0)).otherwise(F.least(F.col("at"), F.lit(cfg.window - 1)))
    around = F.when(F.col("at") >= 0, F.translate(F.array_join(F.slice("w", F.col("at") - F.col("lead") + 1, 2 * cfg.window), " "), UPPER, LOWER))
    distinct = stage(tokens.select("token").distinct(), "leak-distinct")
    blocks = max(1, -(-distinct.count() // cfg.block_rows))
    out = None
    for block in range(blocks):
        listed = distinct.where(F.pmod("token", F.lit(blocks)) == block)
        if block == 0:
            listed = listed.unionByName(docs.sparkSession.range(1).select(F.lit(ROW).cast("bigint").alias("token")))
        met = found.join(F.broadcast(listed), "token").withColumn("at", at.cast("int")).withColumn("lead", lead.cast("int"))
        met = met.select("id", "text_key", "n_words", "token", "at", "lead", around.alias("around"))
        out = met if out is None else out.unionByName(met)
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, hits).

    documents: (id, text_key, n_words) of every row. hits: (id, text_key,
    spans, items) of each distinct document with a window, where spans are
    (start, size, window) with starts counted in words from 0, and items the
    sorted ids of the items met.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = stage(item_windows(benchmark, cfg, item_col, item_text_col), "leak-items")
    tokens = stage(window_tokens(items, cfg), "leak-tokens")
    found = stage(occurrences(rows, tokens, cfg), "leak-shingles")

    seen = found.where(F.col("at") >= 0)
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    # a shingle that no document has rules its window out
    rarity = tokens.join(counts, "token", "left").groupBy("window", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("best")
    )
    prefix = stage(rarity.where("best.n > 0").select("window", "size", "best.token", "best.offset"), "leak-prefix")
    placed = seen.join(prefix, "token").withColumn("start", F.col("at") - F.col("offset"))
    bounded = placed.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size")), " ")
    true = stage(
        bounded.where(there == F.col("window")).groupBy("id", "text_key")
        .agg(F.collect_set(F.struct("start", "size", "window")).alias("spans")), "leak-spans",
    )
    named = (
        true.select("id", "text_key", F.explode(F.array_distinct(F.transform("spans", lambda s: s["window"]))).alias("window"))
        .join(items.where("item is not null").select("item", "window"), "window")
        .groupBy("id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumnsRenamed({"id": "_id", "text_key": "_key"})
    )
    hits = true.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select(
        "id", "text_key", F.array_sort("spans").alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    return found.where(F.col("at") < 0).select("id", "text_key", "n_words"), hits


def digest(documents: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: words, words within windows, items met and the hash of their ids."""
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    marks = hits.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), covered.alias("n_hit"), "items")
    both = documents.join(marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return both.select(
        F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig(), id_col: str = "doc_id") -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    _, hits = find_leaks(docs, benchmark, cfg, id_col)
    bad = stage(hits.select("id", "text_key"), "leak-bad")
    return without(docs, bad, {"id": id_col, "text_key": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
