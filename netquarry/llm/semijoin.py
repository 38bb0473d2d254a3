"""A map-side prefilter for joins of wide rows with a table of ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.common import bitmap_pieces

#: Bits of the broadcast bitmap per id, and at most (16 MB). Beyond some
#: four million ids more and more other rows are near; what follows stays exact.
BITS_PER_ID = 32
MOST_BITS = 27


def _free(rows: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them unlike all columns of ``rows``."""
    taken = {c.lower() for c in rows.columns}
    while any(n.lower() in taken for n in names):
        names = tuple("_" + n for n in names)
    return list(names)


def split_rows(rows: DataFrame, ids: DataFrame, id_col: str, ids_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(near, far): rows whose id may be among ``ids``, and those whose id is surely not.

    A bitmap over hashes of the ids, sized by their number, is broadcast, so
    that rows which no id names are known before anything is shuffled. ``ids``
    is read twice (its rows are counted first), so it should be stored.
    """
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(BITS_PER_ID * (ids.count() + 1)))))

    def place(column):
        return F.pmod(F.xxhash64(column), F.lit(1 << bits))

    own_at, bit_at, bucket_of, bitmap, near = _free(rows, "_own", "_at", "_bucket", "_bits", "_near")
    maps = bitmap_pieces(ids.select(place(ids[ids_col or id_col]).alias("_bit"))).toDF(bucket_of, bitmap)
    half = [F.conv(F.hex(F.substr(bitmap, F.lit(at), F.lit(4))), 16, 10).cast("bigint") for at in range(1, 65, 4)]
    maps = maps.select(bucket_of, F.array(*[F.shiftleft(a, 32).bitwiseOR(b) for a, b in zip(half[::2], half[1::2])]).alias(bitmap))
    keyed = rows.select("*", place(rows[id_col]).alias(own_at))
    keyed = keyed.select(*[F.col(f"`{c}`") for c in rows.columns], F.shiftright(own_at, 9).alias(own_at), (F.col(own_at) % 512).cast("int").alias(bit_at))
    keyed = keyed.join(F.broadcast(maps), F.col(own_at) == F.col(bucket_of), "left")
    # words of eight bytes, the first one on top; the least bit of a byte comes first
    shift = 56 - (F.col(bit_at) % 64 - F.col(bit_at) % 8) + F.col(bit_at) % 8
    bit_set = F.call_function("shiftright", F.get(bitmap, F.shiftright(bit_at, 6)), shift).bitwiseAND(1) == 1
    marked = keyed.withColumn(near, F.coalesce(bit_set, F.lit(False)))
    extra = (own_at, bit_at, bucket_of, bitmap, near)
    return marked.where(F.col(near)).drop(*extra), marked.where(~F.col(near)).drop(*extra)


def maybe_in(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id may be among ``ids``: all that are, few others."""
    return split_rows(rows, ids, id_col)[0]


def without(rows: DataFrame, gone: DataFrame, keys: dict[str, Column | str] | str, gone_col: str | None = None) -> DataFrame:
    """The rows that ``gone`` doesn't name; a null is a value like any other. Only near rows are shuffled.

    ``keys`` says for columns of ``gone`` what they are compared with, a
    column of ``rows`` or an expression over it; the first one is the id. A
    single column of ``rows`` may be named instead, and that of ``gone`` after it.
    """
    if isinstance(keys, str):
        keys = {gone_col or keys: keys}
    own = [f"g{i}" for i in range(len(keys))]
    names = dict(zip(_free(rows, *(f"_k{i}" for i in range(len(keys)))), keys.values()))
    marked = rows.select("*", *[(F.col(f"`{v}`") if isinstance(v, str) else v).alias(n) for n, v in names.items()])
    first, *_ = names
    near, far = split_rows(marked, gone.select(*[gone[c].alias(o) for c, o in zip(keys, own)]), first, own[0])
    listed = gone.select(*[gone[c].alias(f"{n}_gone") for c, n in zip(keys, names)])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_gone"))
    return far.unionByName(near.join(listed, same, "left_anti")).drop(*names)
