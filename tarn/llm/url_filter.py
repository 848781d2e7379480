"""URL rules and redirect equivalence.

A rule is a host and a path prefix. It fits the host and its subdomains where the url's path
starts with the rule's; of the rules that fit, the longest decides. Pages that declare a
canonical address or redirect elsewhere are aliases of it: connected components over these links
carry a block to all aliases that no rule fits. An explicit allow comes first: it shields its own
url, and in an alias group that holds an allowed url the others are allowed too.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is no
alias of anything; it is allowed. Addresses are nodes as they are written: forms that differ in case, port or
fragment are different nodes. Urls and pages of any length are read whole. Repeated rows are judged each. Of two fitting rules of the same
length allow wins. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .components import components

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
)
_REFRESH = (
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*['"]?([^"'>]+)"""
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def resolve(base: Column, link: Column) -> Column:
    """The absolute form of a link found in the page at ``base``."""
    link = F.btrim(F.replace(link, F.lit("&amp;"), F.lit("&")), F.lit(" \t\n\r"))
    scheme = F.substring_index(base, "://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    return (
        F.when(link == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder.rlike(r"://[^/]+/"), F.concat(folder, link))
        .otherwise(F.concat(site, F.lit("/"), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each page's url with the canonical and the redirect address that it names."""
    canonical = F.concat(*[F.regexp_extract("html", _CANONICAL, k) for k in (1, 2, 3)])
    rows = pages.select(F.col(url).alias("a"), F.col(html).alias("html")).where(F.col("a").contains("://") & F.col("html").isNotNull())
    links = rows.select("a", F.explode(F.array(canonical, F.regexp_extract("html", _REFRESH, 1))).alias("link")).where("link <> ''")
    return links.select("a", resolve(F.col("a"), F.col("link")).alias("b")).where("b is not null and contains(b, '://') and a <> b")


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule and action of every distinct url that a rule (action, host, path) fits."""
    rules = rules.select(
        F.col("host").alias("suffix"), F.col("path").alias("start"), "action",
        F.concat("host", "path").alias("rule"),
    )
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    rows = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.where("host <> ''").withColumn("suffix", F.explode(tails)).join(rules, "suffix")
    rows = rows.where(F.startswith("path", "start"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allows"), F.col("rule").alias("rule")))
    return rows.groupBy("url").agg(best.alias("best")).select(
        "url", "best.rule", F.when(F.col("best.allows"), "allow").otherwise("block").alias("action"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, links: DataFrame | None = None,
          page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` are (action, host, path). ``links`` (a, b) are further pairs of aliases, such as
    logged redirects.
    """
    spark = prepare(pages.sparkSession)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "action string, host string, path string")
    found = page_links(pages, url, html)
    if links is not None:
        found = found.union(links.select("a", "b"))
    groups = components(found)
    listed = pages.select(F.col(url).alias("url")).where("url is not null").union(groups.select("node")).distinct()
    own = rule_verdicts(listed, rules)
    decided = groups.join(own, groups["node"] == own["url"]).groupBy("component").agg(
        F.when(F.max(F.col("action") == "allow"), "allow").otherwise("block").alias("carried"))
    carried = groups.join(decided, "component").select(F.col("node").alias("url"), "carried")
    per_url = own.join(carried, "url", "full_outer").select("url", "rule", F.coalesce("action", "carried").alias("decided"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.join(per_url, "url", "left")
    return rows.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("decided", F.lit("allow")).alias("verdict"),
    )
