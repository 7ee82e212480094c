"""URL filters with redirect equivalence, with DataFrame operations only.

Rules judge a URL by host and path; the longest that fits wins. URLs that name the
same page share the decision: variants of one URL (scheme, fragment, query, trailing
slash, ``.html``) have one node, and redirects and canonical links are edges between
nodes. Connected components of these edges carry a block to all aliases that no rule
of their own judges, unless some alias is allowed by a rule: an allow goes first.

Rules are joined by host suffix and path prefix: every URL offers the suffixes of its
host, with them the beginnings of its path that are as long as some rule's path for that
host, and a rule meets those that equal it. So the number of rules of a host is free.

Links are resolved against their page: ``//host``, ``/path``, ``name``, ``../name`` and
``?query``; ``rel`` may list further words beside ``canonical``. A link that is no web
address (``mailto:``) gives no edge. A ``<base>`` tag is not read.

Defined results: a null URL or one without ``://`` has empty host and path, fits no
rule and is allowed; equal rules with different verdicts allow; repeated rows are
judged alike; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockline.llm.components import connected_components
from stockline.llm.store import ascii_lower, keep

# The rules of the page check.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(url))
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))


def node(url: Column) -> Column:
    """The name shared by variants of one URL; null where there is no host."""
    host, path = host_and_path(url)
    bare = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, bare))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_CANONICAL = r"""(?is)^<link\b.*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
_REFRESH = r"(?is)^<meta\b.*http-equiv\s*=\s*.?refresh"


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` steps taken."""
    def step(done: Column, name: Column) -> Column:
        return F.when(name == ".", done).when(name == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(name)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("CAST(array() AS ARRAY<STRING>)"), step), "/")


def resolve(link: Column, base: Column) -> Column:
    """The address that ``link`` means on page ``base``, without query where it is relative; null for other schemes."""
    root = F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    path = host_and_path(base)[1]
    folder = F.regexp_replace(path, r"[^/]*$", "")
    bare = F.regexp_extract(link, r"^[^?#]*", 0)
    return (
        F.when(link.rlike(_SCHEME + "//"), link).when(link.rlike(_SCHEME), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(bare == "", F.concat(root, path)).when(link.startswith("/"), F.concat(root, _without_dots(bare)))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare)))))


def page_links(pages: DataFrame) -> DataFrame:
    """``source, target`` nodes of the canonical links and the refresh redirects in ``html``."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tags = pages.select("url", F.explode(F.filter(tags, lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))).alias("tag"))
    link = F.when(F.col("tag").rlike(r"(?i)^<link"), F.regexp_extract("tag", r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1)).otherwise(
        F.regexp_extract("tag", r"""(?i)url\s*=\s*["']?([^"'\s>;]+)""", 1))
    return tags.select(node(F.col("url")).alias("source"), node(resolve(link, F.col("url"))).alias("target")).where("source <> target")


def _with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``own`` (its verdict), both null where no rule fits."""
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = pages.where("host <> ''").select("host", "path", F.explode(suffixes).alias("r_host")).distinct()
    lengths = rules.select("r_host", F.length("r_path").alias("r_length")).distinct()
    begins = keys.join(lengths, "r_host").where("r_length <= length(path)").select("host", "path", "r_host", F.expr("substring(path, 1, r_length)").alias("r_path"))
    fits = begins.join(rules, ["r_host", "r_path"])
    longest = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")), (F.col("r_verdict") == "allow").alias("a"), F.concat("r_host", "r_path").alias("rule"), "r_verdict")).alias("best"))
    return pages.join(longest.select("host", "path", "best.rule", F.col("best.r_verdict").alias("own")), ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict``; ``redirects`` adds ``(source, target)`` URLs."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "r_verdict string, r_host string, r_path string")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("source"), node(F.col("target")).alias("target")))
    edges, _ = keep(edges.distinct(), "links")
    groups = connected_components(edges, "source", "target")

    judged = _with_rules(pages.select("page_id", "url"), rules).withColumn("node", node(F.col("url")))
    judged = judged.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    known, _ = keep(judged, "judged")
    votes = known.where("own IS NOT NULL").groupBy("component").agg(F.max(F.col("own") == "allow").alias("allows"))
    return known.join(votes, "component", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", F.when(~F.col("allows"), "block").otherwise("allow")).alias("verdict"))
