"""Secret scan: keyword prefilter, anchored patterns at the hits, embedded checksums.

One Aho-Corasick pass finds keywords in each whole text; a kind's pattern is
tried only where one of its keywords stands, left to right, without overlaps
within a kind. Kinds that carry a checksum count only if it holds. Runs of
hex digits have no keyword: runs long enough are found byte-wise.

Texts that are null or empty have no spans. Rows are handled one by one:
repeated rows give repeated results, and no other column is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import textkit

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def crc_suffix(token: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those between prefix and them."""
    body, tail = token.split("_", 1)[1][:-6], token[-6:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits.rjust(6, "0") == tail


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def mod97(account: str) -> bool:
    account = account.replace(" ", "")
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def signed_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):  # not JSON, or nested too deeply to be a header
        return False


@dataclass(frozen=True)
class Kind:
    """keywords: where to try ``pattern``; ``back``: characters that may stand before the keyword."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    least: int = 0
    group: int = 0
    check: object = None
    gap: int = 0


#: The base kinds come first, in the order that breaks ties.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
         "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Kind("access", ("akia",), "AKIA[A-Z0-9]+", 16),
    Kind("hex", (), "", 32),
    Kind("hosting", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", check=crc_suffix),
    Kind("registry", ("npm_",), "npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", check=crc_suffix),
    Kind("webtoken", ("eyj",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}", check=signed_header),
    Kind("card", ("card", "visa", "mastercard", "amex"), r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", check=luhn, gap=24),
    Kind("account", ("iban",), r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])", check=mod97, gap=12),
    Kind("privatekey", ("-----begin ",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
HEX = re.compile("[0-9a-f]{32,}")


@cache
def automaton():
    found = {}
    for kind in KINDS:
        for word in kind.keywords:
            found.setdefault(word, []).append(kind.name)
    auto = ahocorasick.Automaton()
    for word, names in found.items():
        auto.add_word(word, (len(word), tuple(names)))
    auto.make_automaton()
    return auto


@cache
def patterns():
    return {k.name: re.compile(k.pattern) for k in KINDS if k.pattern}


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_BY_NAME = {k.name: k for k in KINDS}
_ORDER = {k.name: i for i, k in enumerate(KINDS)}


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind."""
    if not text:
        return []
    folded = text.lower()
    if len(folded) != len(text):  # a letter became two: places would shift
        folded = text.translate(_ASCII_LOWER)
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for last, (length, names) in automaton().iter(folded):
        for name in names:
            hits.setdefault(name, []).append(last - length + 1 if not _BY_NAME[name].gap else last + 1)
    for name, places in hits.items():
        kind, pattern, done = _BY_NAME[name], patterns()[name], 0
        for at in sorted(set(places)):
            if kind.gap:  # the keyword introduces the value, which begins a little later
                m = next((x for i in range(max(at, done), min(at + kind.gap, len(text))) if text[i].isalnum()
                          and not text[i - 1].isalnum() and (x := pattern.match(text, i))), None)
            else:
                m = pattern.match(text, at) if at >= done else None
            if not m:
                continue
            if len(m[kind.group]) >= kind.least and (kind.check is None or kind.check(m[0])):
                spans.append((m.start(), m.end(), name))
                done = m.end()
            elif not kind.gap:
                done = m.end()
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def join_spans(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its spans as (kind, start, end, value) in order."""
    ids = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in scan(t)]
                 for t in part.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        return {"id": part.column("id"), "spans": pa.array(found, kind)}

    return textkit.map_arrow(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), rows,
        f"id {ids}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>",
    ).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        id_col, *counts, F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
