"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Equal sets are one
class from the start, found by a 128-bit digest; the join runs over classes.
Every class has a signature of minwise tokens, one per hash function.

Chosen path (Christiani and Pagh, 2017; Christiani et al., 2018): in each of
several independent trees a node selects, by a hash of its path, one or two
of the functions (1 / similarity of them on average), and sends each of its
sets to the child named by the function and the set's minwise token. Similar
sets so meet in some child with a probability that does not fall with depth.

Links are found in three steps, each of which sends pairs to be confirmed and
then joins the components that the confirmed ones link:

1. every set with its node's least one, in the first trees: stars that merge
   most copies, however many there are;
2. a node is compared exhaustively if it has ``node_sets`` sets at most, or if
   at most as many lie outside its largest component: these are compared with
   all of the node, in blocks. Other nodes branch further; at ``depth`` a node
   is compared in blocks, however large: exact, but no longer linear. A block
   has about ``node_sets`` sets of either side at most. In the
   first trees each set passes on its best partner in every other component,
   which merges most of what the stars left;
3. in all trees, of the pairs of different components that are left, those
   whose sketches allow a link are compared on their full sets in the node: each
   text is sent once per node and block, not once per pair, and only links
   come out, however many pairs lie just below the threshold.

Only pairs from different components are compared, so a group of copies never
gives all its pairs. Comparisons within a node use sketches of 256 bytes (one
permutation, minima by bin) and pass on what may reach the threshold (four
standard errors below it and up); every link is confirmed on the full sets,
for which only the texts of such pairs are fetched. Nodes are settled at the
first level at which they are small. The trees are as many as ``recall`` needs
for a pair just at the threshold whose nodes are all settled at ``depth``;
other pairs are found more surely.

Texts that are null, or have no words, have an empty set and link with
nothing; fewer words than five make one shingle. Null ids take part in no
link: their component is null and they are kept. Rows that share an id are
one vertex; if their texts differ, the one with the least hash speaks for the id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import textkit
from netquarry.llm.components import connected_components
from netquarry.llm.semijoin import maybe_in, without
from netquarry.session import stage


@dataclass(frozen=True)
class DedupConfig:
    """percent: least similarity, in hundredths; functions: minwise functions that nodes select from."""

    percent: int = 75
    shingle: int = 5
    functions: int = 128
    recall: float = 0.999
    star_trees: int = 2
    best_trees: int = 4
    node_sets: int = 512
    small_sets: int = 32
    depth: int = 8
    errors: float = 4.0
    seed: int = 1009

    @property
    def trees(self) -> int:
        """As many as find a pair at the threshold with ``recall`` even if nodes are settled only at ``depth``.

        All trees draw from the same functions, so how many of them agree on
        the pair (binomial) is common to all; given that, trees are independent.
        """
        j, n = self.percent / 100, self.functions
        second = 1 / j - 1  # chance of a second function in a node
        agree = np.arange(n + 1)
        weight = np.array([math.comb(n, k) * j**k * (1 - j) ** (n - k) for k in agree])
        one, two = agree / n, agree * (agree - 1) / (n * (n - 1))
        miss = np.zeros(n + 1)
        for _ in range(self.depth):
            on = 1 - miss
            miss = 1 - one * on - second * (one * on - two * on * on)
        trees = 1
        while weight @ miss**trees > 1 - self.recall:
            trees += 1
        return trees


BINS = 256


def shingle_sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    w = textkit.Words(part.column("text"), lower=True)
    hashes, at = w.shingles(size)
    cuts = np.searchsorted(at, w.first)
    short = {}
    for i in np.flatnonzero((w.counts > 0) & (w.counts < size)):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        steps = np.array([textkit.STEP[8 + j] for j in range(len(own))], np.uint64)
        short[i] = textkit.mix(np.array([(own * steps).sum() + np.uint64(len(own))], np.uint64))
    return [short[i] if i in short else np.unique(hashes[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _multipliers(cfg: DedupConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    both = rng.integers(0, 2**64, (2, cfg.functions), dtype=np.uint64)
    return both[0], both[1] | np.uint64(1)


def _bins(every: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each set the least hash of each bin, as a byte; 0 for a bin without any."""
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * BINS + (every & np.uint64(BINS - 1)).astype(np.int64), every >> np.uint64(8))
    out = (1 + textkit.mix(least) % np.uint64(255)).astype(np.uint8)
    out[least == np.iinfo(np.uint64).max] = 0
    return out.reshape(n, BINS)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of the sets behind the bins, and how many bins tell."""
    telling = np.maximum(1, np.count_nonzero(a | b, axis=-1))
    same = np.count_nonzero((a == b) & (a != 0), axis=-1)
    return (same / telling - 1 / 255) * (255 / 254), telling


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cfg: DedupConfig) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sizes allow the threshold and the estimate is not far below it; the estimate."""
    j = cfg.percent / 100
    estimate, telling = similarity(a, b)
    sizes = 100 * np.minimum(na, nb) >= cfg.percent * np.maximum(na, nb)
    return sizes & (estimate >= j - cfg.errors * np.sqrt(j * (1 - j) / telling)), estimate


def sketches(docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(id, text_key, n, f1, f2, sig, bins) of every row of (id, text, text_key): set size and digest, minwise tokens, sketch."""
    kind = docs.schema["id"].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part, cfg.shingle)
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        sig = np.zeros((n, cfg.functions), np.uint32)
        digest = np.zeros((2, n), np.uint64)
        bins = np.zeros((n, BINS), np.uint8)
        if len(full):
            every = np.concatenate([sets[i] for i in full])
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            for j, (x, m) in enumerate(zip(*_multipliers(cfg))):
                v = (every ^ x) * m
                sig[full, j] = np.minimum.reduceat(((v ^ (v >> np.uint64(29))) * m) >> np.uint64(32), starts)
            digest[0, full] = np.add.reduceat(textkit.mix(every + np.uint64(1)), starts)
            digest[1, full] = np.add.reduceat(textkit.mix(every ^ np.uint64(textkit.STEP[20])), starts)
            bins = _bins(textkit.mix(every), np.repeat(np.arange(n), sizes), n)
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * cfg.functions, pa.array(sig.view(np.int32).ravel()))
        return {
            "id": part.column("id"), "text_key": part.column("text_key"), "n": sizes, "f1": digest[0].view(np.int64),
            "f2": digest[1].view(np.int64), "sig": lists, "bins": pa.array([b.tobytes() for b in bins], pa.binary()),
        }

    return textkit.map_arrow(docs, rows, f"id {kind}, text_key bigint, n bigint, f1 bigint, f2 bigint, sig array<int>, bins binary")


def _children(rows: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(tree, node, id, sig) one level down: a child for each function its node selects."""
    first = F.pmod(F.xxhash64(F.lit(cfg.seed), "tree", "node"), F.lit(cfg.functions))
    second = F.pmod(F.xxhash64(F.lit(cfg.seed + 1), "tree", "node"), F.lit(cfg.functions - 1))
    second = F.when(second >= first, second + 1).otherwise(second)  # another one than the first
    extra = F.pmod(F.xxhash64(F.lit(cfg.seed + 2), "tree", "node"), F.lit(1000)) < round(1000 * (100 / cfg.percent - 1))
    picked = F.when(extra, F.array(first, second)).otherwise(F.array(first))
    branch = rows.withColumn("f", F.explode(picked))
    return branch.select("tree", F.xxhash64("node", "f", F.element_at("sig", (F.col("f") + 1).cast("int"))).alias("node"), "id", "sig")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two sets at least, with the node's least id."""
    least = rows.groupBy("tree", "node").agg(F.count("*").alias("members"), F.min("id").alias("least")).where("members > 1")
    return rows.join(least.drop("members"), ["tree", "node"])


def stream_groups(df: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """``fn(group, carried)`` over the rows of each key, in order, as Arrow batches bring them.

    A group may come in several parts; ``carried`` is a dict for what later
    parts need of earlier ones, empty at the start of a group. ``fn`` returns
    a frame. What a task holds is one batch and what ``fn`` carries.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(frames):
        last, carried = None, {}
        for frame in frames:
            if not len(frame):
                continue
            new = np.zeros(len(frame), bool)
            new[0] = True
            for k in keys:
                values = frame[k].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], len(frame)]):
                key = tuple(frame[k].iat[a] for k in keys)
                if key != last:
                    last, carried = key, {}
                out = fn(frame.iloc[a:b], carried)
                if out is not None and len(out):
                    yield out

    return dealt.mapInPandas(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, cfg: DedupConfig, block: int = 64) -> DataFrame:
    """The pairs (a, b) of ids whose full sets reach the threshold.

    Each ``a`` meets its partners in blocks: its text is sent once per block,
    a partner's text once per pair. ``ka`` and ``kb`` say which text is an
    id's.
    """
    busy = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / block)).cast("int")
    dealt = stage(pairs.join(busy, "a").select("a", "ka", "b", "kb", salt.alias("block")), "dedup-pairs")
    heads = dealt.select(F.col("a").alias("id"), F.col("ka").alias("text_key"), "a", "block", F.lit(0).alias("part")).distinct()
    tails = dealt.select(F.col("b").alias("id"), F.col("kb").alias("text_key"), "a", "block", F.lit(1).alias("part"))
    asked = heads.unionByName(tails)
    ids = dealt.select(F.explode(F.array("a", "b")).alias("id"))
    near = maybe_in(texts, ids).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = near.join(asked, ["id", "text_key"]).drop("text_key").repartition("a", "block").sortWithinPartitions("a", "block", "part")

    def linked(batches):
        head = None
        for piece in textkit.slices(batches):
            a, b = [], []
            parts = zip(piece.column("id").to_pylist(), piece.column("a").to_pylist(), piece.column("part").to_pylist())
            for (own, lead, part), found in zip(parts, shingle_sets(piece, cfg.shingle)):
                if part == 0:
                    head = found
                    continue
                common = len(np.intersect1d(head, found, assume_unique=True))
                if common and 100 * common >= cfg.percent * (len(head) + len(found) - common):
                    a.append(lead)
                    b.append(own)
            ids = piece.schema.field("a").type
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, ids), "b": pa.array(b, ids)})

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(linked, f"a {kind}, b {kind}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def _star(crowded: DataFrame, sketch: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Pairs of each set with its node's least one that may reach the threshold."""
    pairs = crowded.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    both = pairs.join(sketch.toDF("a", "ka", "na", "ba"), "a").join(sketch.toDF("b", "kb", "nb", "bb"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = (np.asarray(batch.column(c)) for c in ("na", "nb"))
                good, _ = may_link(_matrix(batch.column("ba")), _matrix(batch.column("bb")), *sizes, cfg)
                yield batch.select(["a", "ka", "b", "kb"]).filter(pa.array(good))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "ka", "b", "kb", "na", "nb", "ba", "bb").mapInArrow(run, f"a {kind}, ka bigint, b {kind}, kb bigint")


def _label(rows: DataFrame, known: DataFrame, id_col: str, out: str) -> DataFrame:
    labels = known.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return rows.join(labels, F.col(id_col) == F.col("_node"), "left").withColumn(out, F.coalesce("_component", id_col)).drop("_node", "_component")


def _mixed(rows: DataFrame, known: DataFrame, cfg: DedupConfig, last: bool) -> DataFrame:
    """Rows of nodes with several components, with component, the node's largest, its blocks, and whether it is compared."""
    labelled = _label(rows, known, "id", "component")
    sizes = labelled.groupBy("tree", "node", "component").agg(F.count("*").alias("c"))
    tops = sizes.groupBy("tree", "node").agg(
        F.sum("c").alias("members"), F.max(F.struct("c", "component")).alias("best"), F.count("*").alias("parts")
    ).where("parts > 1")
    few = (F.col("members") <= cfg.node_sets) | (F.col("members") - F.col("best.c") <= cfg.node_sets) | F.lit(last)
    blocks, asking = F.ceil(F.col("members") / cfg.node_sets), F.ceil((F.col("members") - F.col("best.c")) / cfg.node_sets)
    tops = tops.select("tree", "node", F.col("best.component").alias("top"), "members", blocks.alias("blocks"), asking.alias("ask_blocks"), few.alias("few"))
    return labelled.join(tops, ["tree", "node"])


def _blocks(mixed: DataFrame, sketch: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Rows of nodes dealt to blocks, one for each pair of a share of the sets outside
    the node's largest component (part 0) and a share of all sets (part 1)."""

    def share(seed: int, count: str):
        return F.pmod(F.xxhash64(F.lit(cfg.seed + seed), "id"), F.col(count))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    cols = ["tree", "node", "id", "component", "blocks"]
    lying = mixed.select(*cols, F.lit(1).alias("part"), share(3, "blocks").alias("lie"), every("ask_blocks").alias("ask"))
    meeting = mixed.where("component <> top").select(*cols, F.lit(0).alias("part"), every("blocks").alias("lie"), share(4, "ask_blocks").alias("ask"))
    dealt = lying.unionByName(meeting).withColumn("block", F.col("ask") * F.col("blocks") + F.col("lie")).drop("ask", "lie", "blocks")
    return dealt.join(sketch, "id")


class Asks:
    """The sets of a block that meet all others, gathered as their rows come (they come first)."""

    def __init__(self, group: pd.DataFrame, carried: dict, cfg: DedupConfig):
        self.bins = np.frombuffer(b"".join(group["bins"]), np.uint8).reshape(len(group), BINS)
        self.cols = {c: group[c].to_numpy() for c in ("id", "text_key", "component", "n")}
        self.asks = (group["part"] == 0).to_numpy()
        self.parts, self.cfg = carried.setdefault("asks", []), cfg
        if self.asks.any():
            self.parts.append({"bins": self.bins[self.asks]} | {c: v[self.asks] for c, v in self.cols.items()})
        self.bins = self.bins[~self.asks]
        self.cols = {c: v[~self.asks] for c, v in self.cols.items()}

    def meetings(self):
        """(gathered part, place in it, places of the sets here it may link with, their estimates)."""
        components, sizes = self.cols["component"], self.cols["n"]
        for p, part in enumerate(self.parts if len(sizes) else ()):
            for i in range(len(part["id"])):
                size = part["n"][i]
                fit = 100 * np.minimum(sizes, size) >= self.cfg.percent * np.maximum(sizes, size)
                at = np.flatnonzero((components != part["component"][i]) & fit)
                if len(at):
                    good, estimate = may_link(self.bins[at], part["bins"][i], sizes[at], size, self.cfg)
                    if good.any():
                        yield p, i, at[good], estimate[good]


def _small_pairs(batches, cfg: DedupConfig):
    """(rows, i, j, estimate) for runs of whole nodes: the places of rows of one node that may link.

    Rows come sorted by node, few to a node; all nodes of a batch are compared
    at once, each row with the next, the next but one, and so on. The last
    node of a batch waits for the next batch.
    """
    held = None
    for batch in _and_none(batches):
        rows = held if batch is None else batch.to_pandas() if held is None else pd.concat([held, batch.to_pandas()], ignore_index=True)
        if rows is None or not len(rows):
            continue
        tree, node = rows["tree"].to_numpy(), rows["node"].to_numpy()
        end = len(rows)
        if batch is not None:
            last = np.flatnonzero((tree != tree[-1]) | (node != node[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
        held, rows = rows.iloc[end:].reset_index(drop=True), rows.iloc[:end]
        if not end:
            continue
        tree, node = tree[:end], node[:end]
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(end, BINS)
        component, size = rows["component"].to_numpy(), rows["n"].to_numpy()
        left, right, estimates = [], [], []
        for gap in range(1, cfg.small_sets):
            same = np.flatnonzero((tree[gap:] == tree[:-gap]) & (node[gap:] == node[:-gap])) if end > gap else np.zeros(0, np.int64)
            if not len(same):
                break
            i, j = same, same + gap
            apart = component[i] != component[j]
            good, estimate = may_link(bins[i[apart]], bins[j[apart]], size[i[apart]], size[j[apart]], cfg)
            left.append(i[apart][good])
            right.append(j[apart][good])
            estimates.append(estimate[good])
        if sum(map(len, left)):
            yield rows, np.concatenate(left), np.concatenate(right), np.concatenate(estimates)


def _and_none(batches):
    yield from batches
    yield None


def _small_rows(mixed: DataFrame, sketch: DataFrame, cfg: DedupConfig) -> DataFrame:
    rows = mixed.where(F.col("members") <= cfg.small_sets).select("tree", "node", "id", "component").join(sketch, "id")
    return rows.repartition("tree", "node").sortWithinPartitions("tree", "node")


def _best_pairs(mixed: DataFrame, sketch: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, ka, b, kb): each set's likeliest partner in every other component of a node or block."""
    kind = mixed.schema["id"].dataType.simpleString()
    schema = f"a {kind}, ka bigint, b {kind}, kb bigint"

    def small(batches):
        for rows, i, j, estimate in _small_pairs(batches, cfg):
            ids, keys, component = (rows[c].to_numpy() for c in ("id", "text_key", "component"))
            ways = pd.DataFrame({"me": np.concatenate((i, j)), "it": np.concatenate((j, i)), "e": np.tile(estimate, 2)})
            ways["c"] = component[ways["it"]]
            best = ways.sort_values("e", ascending=False, kind="stable").drop_duplicates(["me", "c"])
            out = [(*min(x, y), *max(x, y)) for x, y in zip(zip(ids[best["me"]], keys[best["me"]]), zip(ids[best["it"]], keys[best["it"]]))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["a", "ka", "b", "kb"]), preserve_index=False)

    def candidates(group: pd.DataFrame, carried: dict) -> pd.DataFrame:
        asks, out = Asks(group, carried, cfg), []
        ids, keys, components = (asks.cols[c] for c in ("id", "text_key", "component"))
        for p, i, at, estimate in asks.meetings():
            at = at[np.argsort(-estimate, kind="stable")]
            at = at[np.unique(components[at], return_index=True)[1]]
            me = (asks.parts[p]["id"][i], asks.parts[p]["text_key"][i])
            out += [(*min(me, it), *max(me, it)) for it in zip(ids[at], keys[at])]
        return pd.DataFrame(out, columns=["a", "ka", "b", "kb"])

    large = _blocks(mixed.where(F.col("members") > cfg.small_sets), sketch, cfg)
    return (
        _small_rows(mixed, sketch, cfg).mapInArrow(small, schema)
        .unionByName(stream_groups(large, ["tree", "node", "block"], ["part"], candidates, schema)).distinct()
    )


def _exact_links(mixed: DataFrame, sketch: DataFrame, texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, b): all links between different components of a node."""
    keys = ["tree", "node", "block"]
    kind = mixed.schema["id"].dataType.simpleString()
    schema = f"part int, id {kind}, text_key bigint, component {kind}, tree int, node bigint, block bigint"

    def small(batches):
        """The rows that may link with one of their node at all."""
        for rows, i, j, _ in _small_pairs(batches, cfg):
            for part, at in ((0, np.unique(i)), (1, np.unique(j))):
                picked = rows.iloc[at]
                out = pd.DataFrame({"part": np.int32(part), **{c: picked[c].to_numpy() for c in ("id", "text_key", "component", "tree", "node")}})
                out["block"] = np.int64(0)
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    def hopeful(group: pd.DataFrame, carried: dict) -> pd.DataFrame:
        asks = Asks(group, carried, cfg)
        here, there = set(), {}
        for p, i, at, _ in asks.meetings():
            here.update(at.tolist())
            there[p, i] = True
        rows = [(1, *(asks.cols[c][i] for c in ("id", "text_key", "component"))) for i in sorted(here)]
        rows += [(0, *(asks.parts[p][c][i] for c in ("id", "text_key", "component"))) for p, i in there]
        out = pd.DataFrame(rows, columns=["part", "id", "text_key", "component"])
        for k in keys:
            out[k] = group[k].iloc[0]
        return out

    large = _blocks(mixed.where(F.col("members") > cfg.small_sets), sketch, cfg)
    asked = stage(
        _small_rows(mixed, sketch, cfg).mapInArrow(small, schema)
        .unionByName(stream_groups(large, keys, ["part"], hopeful, schema)).distinct(), "dedup-hopeful",
    )
    near = maybe_in(texts, asked.select("id")).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))

    def linked(batches):
        group, asks = None, []
        for piece in textkit.slices(batches):
            found_links = []
            names = ("tree", "node", "block", "part", "id", "component")
            for (*key, part, own, component), found in zip(zip(*(piece.column(c).to_pylist() for c in names)), shingle_sets(piece, cfg.shingle)):
                if key != group:
                    group, asks = key, []
                if part == 0:
                    asks.append((own, component, found))
                    continue
                for other, theirs, head in asks:
                    if component == theirs or 100 * min(len(head), len(found)) < cfg.percent * max(len(head), len(found)):
                        continue
                    common = len(np.intersect1d(head, found, assume_unique=True))
                    if 100 * common >= cfg.percent * (len(head) + len(found) - common):
                        found_links.append((min(own, other), max(own, other)))
            ids = piece.schema.field("id").type
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in found_links], ids) for i, c in enumerate("ab")})

    dealt = near.join(asked, ["id", "text_key"]).repartition(*keys).sortWithinPartitions(*keys, "part")
    return dealt.mapInArrow(linked, f"a {kind}, b {kind}").distinct()


def near_components(docs: DataFrame, cfg: DedupConfig = DedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, component) of every row of ``docs``; ``text_key`` is a hash of the text."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    drawn = stage(sketches(texts.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))), cfg), "dedup-sketches")
    digest = ["f1", "f2", "n"]
    usable = drawn.where("n > 0 and id is not null")
    classes = stage(usable.groupBy(*digest).agg(F.min("id").alias("id")), "dedup-classes")
    speaking = usable.join(classes.select("id").distinct(), "id").groupBy("id").agg(F.min("text_key").alias("text_key"))
    sets = stage(usable.join(speaking, ["id", "text_key"]).dropDuplicates(["id"]).select("id", "text_key", "n", "sig", "bins"), "dedup-sets")
    sketch = sets.select("id", "text_key", "n", "bins")
    known = classes.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)

    def settle(fresh: DataFrame, known: DataFrame) -> DataFrame:
        """The components known so far, joined where confirmed links touch them."""
        fresh = stage(fresh, "dedup-links")
        if fresh.isEmpty():
            return known
        ends = _label(_label(fresh, known, "a", "ca"), known, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = connected_components(ends)
        moved = known.join(joined.toDF("_old", "_new"), F.col("component") == F.col("_old"), "left")
        added = joined.join(known.select("node"), "node", "left_anti")
        return stage(moved.select("node", F.coalesce("_new", "component").alias("component")).unionByName(added), "dedup-components")

    rows = sets.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree")).withColumn("node", F.lit(0).cast("bigint"))
    few, level = None, 0
    while few is None or not many.isEmpty():
        rows, level = _children(rows, cfg), level + 1
        crowded = stage(_crowded(stage(rows.drop("sig"), "dedup-children")), "dedup-nodes")
        if few is None:
            stars = stage(_star(crowded.where(F.col("tree") < cfg.star_trees), sketch, cfg), "dedup-stars")
            known = settle(confirm(stars, texts, cfg), known)
        mixed = stage(_mixed(crowded.drop("least"), known, cfg, level >= cfg.depth), "dedup-mixed")
        few = mixed.where("few") if few is None else few.unionByName(mixed.where("few"))
        many = mixed.where(~F.col("few"))
        rows = many.select("tree", "node", "id").join(sets.select("id", "sig"), "id")
    likely = _best_pairs(few.where(F.col("tree") < cfg.best_trees), sketch, cfg)
    known = settle(confirm(stage(likely, "dedup-best"), texts, cfg), known)
    left = _mixed(few.select("tree", "node", "id"), known, cfg, True)
    known = settle(_exact_links(left, sketch, texts, cfg), known)
    placed = _label(classes, known, "id", "component").select(*[F.col(c).alias(f"_{c}") for c in digest], "component")
    own = drawn.select("id", "text_key", *digest).join(placed, [F.col(c) == F.col(f"_{c}") for c in digest], "left")
    lone = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return own.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), lone.alias("component"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    kept = F.coalesce(F.col(id_col) == F.col("component"), F.lit(True))
    return found.select(id_col, "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, cfg: DedupConfig = DedupConfig(), id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is their component's least, with their own columns; of rows that share it, all.

    Rows that share an id but not the text are decided one by one.
    """
    found = near_components(docs, cfg, id_col)
    gone = found.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("gone"), F.col("text_key").alias("key")).distinct()
    return without(docs, stage(gone, "dedup-gone"), {"gone": id_col, "key": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
