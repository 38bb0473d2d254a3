"""Domain, entropy, hashing and pattern expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def labels(domain) -> Column:
    return F.split(_c(domain), r"\.")


def label_count(domain) -> Column:
    return F.size(labels(domain))


def parent_domain(domain) -> Column:
    """Last two labels; null for fewer than two."""
    return F.when(label_count(domain) >= 2, F.substring_index(_c(domain), ".", -2))


def subdomain(domain) -> Column:
    """Everything before the last two labels; null for fewer than three."""
    parts = labels(domain)
    return F.when(
        F.size(parts) >= 3,
        F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "."),
    )


def second_level(domain) -> Column:
    parts = labels(domain)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def top_level(domain) -> Column:
    return F.element_at(labels(domain), -1)


def shannon_entropy(text) -> Column:
    """Bits per character of the case-folded string; 0 for ''.

    The folded string is bound once through a one-element array: a lambda body
    re-evaluates every outer expression it mentions on each step.
    """
    bound = F.array(F.struct(F.lower(_c(text)).alias("s"), F.length(_c(text)).cast("double").alias("n")))

    def entropy(row):
        s, n = row.getField("s"), row.getField("n")
        chars = F.filter(F.array_distinct(F.split(s, "")), lambda ch: ch != "")

        def add(acc, ch):
            p = (F.length(s) - F.length(F.replace(s, ch, F.lit("")))) / n
            return acc - p * F.log2(p)

        return F.aggregate(chars, F.lit(0.0), add) + F.lit(0.0)

    value = F.get(F.transform(bound, entropy), F.lit(0))
    return F.when(F.length(_c(text)) > 0, value).when(_c(text).isNotNull(), F.lit(0.0))


def consonant_ratio(text) -> Column:
    s = F.lower(_c(text))
    kept = F.length(s) - F.length(F.translate(s, "bcdfghjklmnpqrstvwxyz", ""))
    return F.when(F.length(_c(text)) > 0, kept / F.length(_c(text)))


def has_digit(text) -> Column:
    return F.coalesce(_c(text).rlike("[0-9]"), F.lit(False))


def fingerprint(activity_type, indicators, assets, techniques) -> Column:
    """Stable 16-hex id of a finding, independent of list order."""
    def joined(arr):
        return F.array_join(F.array_sort(_c(arr)), "|")

    body = F.concat_ws("::", _c(activity_type), joined(indicators), joined(assets), joined(techniques))
    return F.substring(F.sha2(body, 256), 1, 16)


def content_id(text) -> Column:
    """First 24 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(_c(text), 256), 1, 24)


def technique_ids(text) -> Column:
    """Distinct ATT&CK technique ids in order of first appearance."""
    return F.array_distinct(
        F.regexp_extract_all(F.upper(_c(text)), F.lit(r"(T\d{4}(?:\.\d{3})?)"), F.lit(1))
    )


def common_name(subject) -> Column:
    got = F.regexp_extract(_c(subject), r"CN=([^,/]+)", 1)
    return F.when(got != "", got)


def organisation(subject) -> Column:
    got = F.regexp_extract(_c(subject), r"(?:^|[,/ ])O=([^,/]+)", 1)
    return F.when(got != "", got)


def first_value(arr) -> Column:
    """First element of a multi-valued field, null when empty."""
    return F.get(_c(arr), F.lit(0))


def meaningful(text) -> Column:
    """The value unless it is one of the log's placeholders for 'nothing'."""
    return F.when(~F.coalesce(_c(text), F.lit("")).isin("", "-", "null"), _c(text))


def any_contains(text, needles) -> Column:
    """True when the text holds any of a short literal list."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(_c(text), F.lit(needle))
    return F.coalesce(found, F.lit(False))


def first_contained(text, needles) -> Column:
    """The first list entry the text holds, in list order, else null."""
    return F.coalesce(*[F.when(F.contains(_c(text), F.lit(n)), F.lit(n)) for n in needles])


def clamp(value, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(_c(value), F.lit(hi)))
