"""URL filters: allow and block rules, carried to the aliases of a page.

Pages that redirect to each other or name each other as canonical are one group,
found as connected components over the links. A rule that fits a page's own url
decides for it; a page without one follows its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm import scratch
from meterlight.llm.graph import components

ALLOW, BLOCK = "allow", "block"
#: Rules up to which they are one expression, with the same results as joining by host;
#: and rules, of some hundred bytes each, up to which the joined ones are broadcast.
INLINE_RULES, BROADCAST_RULES = 200, 100_000

#: Tags up to their end, which may stand inside quotes only; possessive, so that a
#: tag of any length takes one pass and no stack.
_TAG = r"""(?i)<%s\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++))"""
_REL, _HREF, _EQUIV, _CONTENT = (rf"(?i)[\s\"']{name}{_VALUE}" for name in ("rel", "href", "http-equiv", "content"))
_REFRESH = r"""(?i)^\s*+[0-9.]*+\s*+[;,]?\s*+url\s*+=\s*+['"]?\s*+([^"'\s<>]++)"""

#: A-Z alone; lower() would also change other letters.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """A url as a node of the link graph: lower-cased scheme and host, no fragment."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?://)", 1), _UPPER, _LOWER)
    return F.when(url.contains("://"), F.concat(scheme, host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def resolve(link: Column, base: Column) -> Column:
    """A link of a page as a url: absolute, ``//host/...`` or ``/path``; any other
    form is relative to the folder of the page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    top = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(top, link))
        .when(link != "", F.concat(top, F.when(folder == "", "/").otherwise(folder), link))
    )


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst) of canonical links and refresh redirects in whole pages."""
    html, url = F.col(html_col), F.col(url_col)
    value = lambda tag, pattern: F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    tags = lambda name: F.regexp_extract_all(html, F.lit(_TAG % name), F.lit(0))
    named = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(value(t, _REL)), r"\s+"), "canonical"))
    canonical = F.nullif(value(F.try_element_at(named, F.lit(1)), _HREF), F.lit(""))
    moved = F.filter(tags("meta"), lambda t: F.lower(F.trim(value(t, _EQUIV))) == "refresh")
    refresh = F.nullif(F.regexp_extract(value(F.try_element_at(moved, F.lit(1)), _CONTENT), _REFRESH, 1), F.lit(""))
    hinted = pages.where(html.rlike("(?i)canonical|refresh")).select(url.alias("u"), F.explode(F.array(canonical, refresh)).alias("l"))
    edges = hinted.where("l is not null").select(node(F.col("u")).alias("src"), node(resolve(F.replace(F.col("l"), F.lit("&amp;"), F.lit("&")), F.col("u"))).alias("dst"))
    return edges.where("src is not null and dst is not null and src <> dst")


def ruled(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``pages`` (with __host and __path) with __rule and __said: the longest
    fitting rule and its verdict, or nulls. Rules: (verdict, host/path)."""
    if isinstance(rules, DataFrame):
        small = rules.limit(INLINE_RULES + 1).collect()
        if len(small) > INLINE_RULES:
            return _joined(pages, rules.toDF("verdict", "rule"))
        rules = [(r[0], r[1]) for r in small]
    found, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Shorter rules first, so that longer ones override; of the same rule twice, allow.
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), r[1], r[0] == ALLOW)):
        name, _, rest = rule.partition("/")
        name = name.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((F.col("__host") == name) | F.col("__host").endswith("." + name)) & F.col("__path").startswith("/" + rest)
        found, said = F.when(fits, rule).otherwise(found), F.when(fits, verdict).otherwise(said)
    return pages.withColumns({"__rule": found, "__said": said})


def _joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Many rules: each host and its parent domains, joined to rules by host."""
    parts = F.split("__host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = pages.select("__host", "__path").distinct().withColumn("on", F.explode(hosts))
    given = rules.select("verdict", "rule", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("on"), F.expr("concat('/', substring(rule, locate('/', concat(rule, '/')) + 1))").alias("start"))
    given = F.broadcast(given) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else given
    fit = asked.join(given, "on").where(F.col("__path").startswith(F.col("start")))
    best = fit.groupBy("__host", "__path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", (F.col("verdict") == ALLOW).alias("a"), "verdict")).alias("best"))
    best = best.select("__host", "__path", F.col("best.rule").alias("__rule"), F.col("best.verdict").alias("__said"))
    return pages.join(best, ["__host", "__path"], "left")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]] | DataFrame,
    *,
    redirects: DataFrame | None = None,
    default: str = ALLOW,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of each row.

    Links come from the pages' canonical links and refresh redirects and from
    ``redirects`` (src, dst: urls), if given. A page with a rule of its own gets
    its verdict. Another page follows its group: allowed if a rule allows any
    page of the group, else blocked if a rule blocks any, else ``default``; so an
    explicit allow takes precedence over every block. Urls that are only linked
    to count as members of their groups.

    A null url, or one without ``://``, has an empty host and path, no links and
    the default verdict. A null page has no links. Rows that repeat are judged
    each time. An empty table gives no rows.
    """
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.toDF("src", "dst").select(node(F.col("src")), node(F.col("dst"))).where("src <> dst"))
    edges = scratch.save(edges.distinct(), "links")
    url = F.col(url_col)
    asked = ruled(pages.select(F.col(id_col).alias("__id"), url.alias("__url"), host(url).alias("__host"), path(url).alias("__path")), rules)
    verdict = F.coalesce("__said", F.lit(default))
    if edges.limit(1).count():
        groups = components(edges)
        urls = groups.select("root", host(F.col("node")).alias("__host"), path(F.col("node")).alias("__path"))
        says = ruled(urls, rules).where("__said is not null").groupBy("root").agg(F.max(F.when(F.col("__said") == ALLOW, 1).otherwise(0)).alias("allowed"))
        carried = groups.join(says, "root").select(F.col("node").alias("__node"), F.when(F.col("allowed") == 1, ALLOW).otherwise(BLOCK).alias("__carried"))
        asked = asked.withColumn("__node", node(F.col("__url"))).join(carried, "__node", "left")
        verdict = F.coalesce("__said", "__carried", F.lit(default))
    return asked.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"))


def allowed(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, **options) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, unchanged."""
    url_col = options.get("url_col", "url")
    plain, url = scratch.renamed(pages, url_col)
    verdicts = judge(pages, rules, **options | {"id_col": url_col}).where(F.col("verdict") == BLOCK).select(F.col(url_col).alias("__u")).distinct()
    return scratch.restored(plain.join(verdicts, plain[url].eqNullSafe(verdicts["__u"]), "left_anti"), pages.columns)


