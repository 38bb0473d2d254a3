"""URL filters whose decisions hold for all aliases of a page.

A rule names a host and the beginning of a path; it fits the host and its
subdomains, and the longest fitting rule is a URL's own verdict. URLs that
redirect to each other, or name each other as canonical, are one page:
redirects, canonical links and refresh targets in the HTML, and forms of a
URL that servers answer alike (scheme, fragment, tracking parameters, index
page, closing slash) are edges, and their connected components the pages. A
URL without a rule of its own is

1. allowed, if any alias has an allow rule (explicit allow takes precedence),
2. blocked, if any alias has a block rule,
3. allowed otherwise.

Rules are found through the few suffixes of a host, not by trying every rule
on every URL. Null URLs and those without ``://`` have no host, no rule and
no aliases, and are allowed; repeated rows get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.components import connected_components
from netquarry.session import stage

ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Parameters that say where a visitor came from, not what to show (public conventions).
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), *ASCII)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_form(url: Column) -> Column:
    """The form that aliases by convention share; null where there is no host."""
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/index\\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, tail))


#: Character references that stand in addresses (fixed values); the ampersand's come last.
REFERENCES = (
    ("(?i)&quot;|&#0*34;|&#x0*22;", '"'), ("(?i)&apos;|&#0*39;|&#x0*27;", "'"), ("(?i)&sol;|&#0*47;|&#x0*2f;", "/"), ("(?i)&colon;|&#0*58;|&#x0*3a;", ":"),
    ("(?i)&quest;|&#0*63;|&#x0*3f;", "?"), ("(?i)&equals;|&#0*61;|&#x0*3d;", "="), ("(?i)&num;|&#0*35;|&#x0*23;", "#"), ("(?i)&amp;|&#0*38;|&#x0*26;", "&"),
)


def decoded(address: Column) -> Column:
    """An attribute's address without character references and blank ends."""
    for pattern, char in REFERENCES:
        address = F.regexp_replace(address, pattern, char)
    return F.trim(address, F.lit(" \t\n\f\r"))


def _without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: (
        F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part)))
    ))
    closed = F.when(F.get(parts, F.size(parts) - 1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.array_join(closed, "/")


def resolve(links: DataFrame, base: str, target: str) -> DataFrame:
    """Turn the references of a column into absolute addresses (RFC 3986, section 5), for bases with a host.

    Every step is a column of its own, so that no pattern is tried twice.
    """
    parts = links.withColumns({"_root": F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1), "_path": path_of(F.col(base))})
    ref = F.col(target)
    folder = F.when(F.col("_path") == "", "/").otherwise(F.regexp_extract("_path", "(?s)^(.*/)", 1))
    whole = (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat("_root", ref))
        .when(F.startswith(ref, F.lit("?")), F.concat("_root", "_path", ref))
        .when(ref.rlike("^(#|$)"), F.regexp_extract(base, "(?s)^([^#]*)", 1))
        .otherwise(F.concat("_root", folder, ref))
    )
    joined = parts.withColumn("_whole", whole)
    dotted = joined.withColumn("_dotted", F.regexp_extract("_whole", r"(?s)^.*?://[^/?#]*([^?#]*/\.\.?(?:/[^?#]*)?)(?:[?#].*)?$", 1))
    head, tail = F.regexp_extract("_whole", "(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract("_whole", "(?s)^.*?://[^?#]*(.*)$", 1)
    clean = F.when(F.col("_dotted") == "", F.col("_whole")).otherwise(F.concat(head, _without_dots(F.col("_dotted")), tail))
    return dotted.withColumn(target, F.coalesce(clean, "_whole")).drop("_root", "_path", "_whole", "_dotted")


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): canonical links and refresh targets as absolute addresses.

    References are resolved against the page's ``<base href>``, if it has one,
    and its URL.
    """
    address = "(?is)(?:\\bhref\\s*=\\s*|\\burl\\s*=\\s*)(\"[^\">]*|'[^'>]*|[^\"'\\s>]+)"

    def address_of(tag: Column) -> Column:
        return decoded(F.regexp_replace(F.regexp_extract(tag, address, 1), "^[\"']|[\"']$", ""))

    tags = F.regexp_extract_all(F.col(html_col), F.lit("(?is)(<(?:link|meta|base)\\b[^>]*>)"), F.lit(1))
    marked = F.filter("tags", lambda t: t.rlike("(?is)\\brel\\s*=\\s*[\"']?canonical\\b|http-equiv\\s*=\\s*[\"']?refresh\\b"))
    bases = F.filter("tags", lambda t: t.rlike("(?is)^<base\\b.*\\bhref\\s*="))
    found = pages.select(F.col(url_col).alias("source"), tags.alias("tags")).select("source", bases.alias("bases"), F.explode(marked).alias("tag"))
    links = found.select("source", F.get("bases", F.lit(0)).alias("base_tag"), address_of(F.col("tag")).alias("target")).where("target <> ''")
    plain = links.where("base_tag IS NULL").select("source", F.col("source").alias("base"), "target")
    moved = resolve(links.where("base_tag IS NOT NULL").withColumn("base", address_of(F.col("base_tag"))), "source", "base")
    both = plain.unionByName(moved.select("source", "base", "target"))
    return resolve(both, "base", "target").select("source", "target")


def own_rule(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """(host, path, rule, decision): the longest fitting rule of each distinct host and path that has one.

    ``rules`` has host, path and decision (allow or block); of two rules of
    the same text the allowing one holds.
    """
    parts = F.split(F.col(host), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tries = urls.select(host, path).distinct().select(host, path, F.explode(suffixes).alias("_suffix"))
    listed = rules.groupBy(rules["host"].alias("_rule_host"), rules["path"].alias("_rule_path")).agg(F.min("decision").alias("decision"))
    fits = tries.join(listed, (F.col("_suffix") == F.col("_rule_host")) & F.startswith(F.col(path), F.col("_rule_path")))
    rule = F.concat("_rule_host", "_rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "decision"))
    return fits.groupBy(host, path).agg(best.alias("_best")).select(host, path, "_best.rule", "_best.decision")


def url_verdicts(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, alias_group) of every row.

    ``redirects`` has source and target URLs; ``alias_group`` is the least
    plain form among the aliases.
    """
    url = F.col("_url")
    rows = stage(
        pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url")).select(
            "_id", "_url", host_of(url).alias("host"), path_of(url).alias("path"), plain_form(url).alias("_form")
        ),
        "url-rows",
    )
    links = redirects.select("source", "target") if redirects is not None else None
    if html_col:
        found = html_links(pages, url_col, html_col)
        links = found if links is None else links.unionByName(found)
    if links is None:
        groups = rows.select(F.col("_form").alias("node"), F.col("_form").alias("component")).limit(0)
    else:
        # a URL that is only a way-station needs no page of its own; its rule counts as well
        links = stage(links.where("source is not null and target is not null"), "url-links")
        forms = links.select(plain_form(F.col("source")).alias("a"), plain_form(F.col("target")).alias("b"))
        groups = connected_components(forms)
    stations = rows.select("host", "path", "_form")
    if links is not None:
        for end in ("source", "target"):
            stations = stations.unionByName(links.select(host_of(F.col(end)).alias("host"), path_of(F.col(end)).alias("path"), plain_form(F.col(end)).alias("_form")))
    decided = stage(own_rule(stations, rules), "url-rules")
    voted = stations.distinct().join(decided, ["host", "path"]).join(groups, F.col("_form") == F.col("node"), "left")
    group = F.coalesce("component", "_form")
    votes = voted.where("_form is not null").groupBy(group.alias("_group")).agg(F.min("decision").alias("_heard"))  # allow sorts before block
    placed = rows.join(groups, F.col("_form") == F.col("node"), "left").withColumn("alias_group", group).drop("node", "component")
    own = decided.withColumnRenamed("decision", "_own")
    return (
        placed.join(own, ["host", "path"], "left").join(votes, F.col("alias_group") == F.col("_group"), "left")
        .select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_own", "_heard", F.lit("allow")).alias("verdict"), "alias_group")
    )
