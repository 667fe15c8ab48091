"""URL filters with redirect equivalence, in DataFrame operations only.

A rule blocks or allows a host, with its subdomains, below a path; the longest rule that fits decides. A page that no rule fits is judged
with its aliases: URLs in one form (scheme, default port, user, fragment, tracking parameters left aside) are one node, and nodes are linked by
known redirects, by a page's canonical link and its refresh, and by a ``www`` or mobile host that stands for the bare one. A
component of linked nodes with a blocked one in it is blocked. An explicit allow goes before that: the page it fits is allowed, whatever its
aliases. It covers that page alone, as otherwise a redirect to an allowed page would be a way around every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint, components, fresh, lower_ascii

#: A rule: allow or block, a host without a leading dot, and a path from its first slash on.
Rule = tuple[str, str, str]
#: Rules that are literals of the plan, and rows of rules that are broadcast; beyond, they are joined by shuffling.
MOST_LITERALS, MOST_BROADCAST = 500, 200_000
#: First labels of hosts that stand for the bare host, and query parameters that only track.
STAND_INS = ["www", "m"]
TRACKING = ["utm_[^&=]*", "gclid", "fbclid"]
#: What of a page can hold a link of the page's own; comments and scripts are matched so as to be passed over.
TAGS = r"(?is)<!--.*?-->|<script\b.*?</script>|<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CONTENT_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>]+)"""


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; empty for null and without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty for null and without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def node_of(url: Column) -> Column:
    """The URL in the form that its variants share: bare host, path (at least a slash) and the query without tracking parameters; null if it has no host."""
    host = _bare(host_of(url))
    path = path_of(url)
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.ltrim(F.regexp_replace(query, f"(^|&)(?:{'|'.join(TRACKING)})(?:=[^&]*)?(?=&|$)", ""), F.lit("&"))
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", whole)


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::(?:80|443)?)?$", "")


def _host_of_node(node: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(node, r"^[^/]*", 0), r":\d+$", "")


def targets(url: Column, html: Column) -> Column:
    """The absolute URLs of a page's canonical links and refreshes, as an array; relative ones follow from the page's URL, other schemes are none."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAGS), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL)), lambda t: F.concat(*(F.regexp_extract(t, HREF, k) for k in (1, 2, 3))))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(t, CONTENT_URL, 1))
    base = F.concat(F.regexp_extract(url, r"^(.*?)://", 1), F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?#]*", 0))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")

    def absolute(t: Column) -> Column:
        t = F.trim(F.replace(t, F.lit("&amp;"), F.lit("&")))
        return (
            F.when((t == "") | t.startswith("#"), None)
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(t.startswith("/"), F.concat(base, t))
            .when(t.startswith("?"), F.concat(base, path_of(url), t))
            .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), t))
        )

    return F.filter(F.transform(F.concat(canonical, refresh), absolute), lambda t: t.isNotNull())


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def ruled(df: DataFrame, host: str, path: str, rules: list[Rule] | DataFrame, to: str, most_literals: int = MOST_LITERALS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with ``to``: the longest of ``rules`` that fits, as a struct (size, rule, says), or null. Of two rules for one place, allow goes first.

    ``rules`` are a list, or a table ``(says, host, path)``. Few are literals. Others meet every suffix of each distinct host and path
    in a join on the suffix; a suffix that a third of all rows have meets its few rules in a join that Spark can split.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= most_literals:
        each = [F.when(_fits(F.col(host), F.col(path), F.lit(h), F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(says == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(says).alias("says"))) for says, h, p in rules]
        found = F.greatest(*each, F.lit(None)) if each else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,says:string>")
        return df.withColumn(to, found)
    table = rules if isinstance(rules, DataFrame) else df.sparkSession.createDataFrame(rules, "says string, host string, path string")
    r = table.select(F.col("host").alias("suffix"), F.col("path").alias("below"), F.struct(F.length(F.concat("host", "path")).alias("size"), (F.col("says") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), "says").alias("found"))
    small = r.limit(most_broadcast + 1).count() <= most_broadcast
    places = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", "\\.")
    suffixes = places.select("h", "p", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    met = suffixes.join(F.broadcast(r) if small else r, "suffix").where(F.startswith("p", F.col("below")))
    best = met.groupBy("h", "p").agg(F.max("found").alias(to))
    h, p = fresh(df.drop(to), "h_", "p_")
    return df.join(best.toDF(h, p, to), (F.col(host) == F.col(h)) & (F.col(path) == F.col(p)), "left").drop(h, p)


def judge(
    pages: DataFrame,
    rules: list[Rule] | DataFrame,
    links: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    most_literals: int = MOST_LITERALS,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict, by)`` of every row of ``pages``; ``by`` says what decided: ``rule``, ``alias`` or ``none`` (allowed).

    ``links(source, target)`` are further URLs known to be the same, as redirects that a crawl met. Null URLs and those without ``://`` have an
    empty host, no rule and no aliases, and are allowed. A null or empty html has no links; a very long one is read whole, in its row. Rows that are repeated each
    have their result. Loops and chains of links are components like others; links to pages that are not in the table count. An
    empty table gives none, an empty list of rules allows all. Other columns are not read.
    """
    options = {"most_literals": most_literals, "most_broadcast": most_broadcast}
    html = F.col(f"`{html_col}`") if html_col else F.lit(None).cast("string")
    given = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    rows = ruled(given.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")), "host", "path", rules, "own", **options)

    linked = given.where("url is not null").select(node_of(F.col("url")).alias("a"), F.explode(targets(F.col("url"), F.col("html"))).alias("target")).select("a", node_of(F.col("target")).alias("b"))
    stands = F.regexp_extract("a", rf"^(?:{'|'.join(STAND_INS)})\.([^/]*\.[^/]*/.*)$", 1)
    bare = given.select(node_of(F.col("url")).alias("a")).select("a", stands.alias("b")).where("b <> ''")
    edges = linked.unionByName(bare)
    if links is not None:
        edges = edges.unionByName(links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    found = components(edges)
    names = found.select("node", "label", _host_of_node(F.col("node")).alias("h"), path_of(F.concat(F.lit("://"), F.col("node"))).alias("p"))
    blocked = ruled(names, "h", "p", rules, "r", **options).groupBy("label").agg(F.bool_or(F.coalesce(F.col("r.says") == "block", F.lit(False))).alias("bad")).where("bad")
    bad = checkpoint(found.join(blocked, "label").select("node", "bad"))

    alone = rows.withColumn("h", _host_of_node(F.col("node"))).withColumn("p", path_of(F.concat(F.lit("://"), F.col("node"))))
    judged = ruled(alone, "h", "p", rules, "same", **options).join(bad, "node", "left")
    own, same = F.col("own").isNotNull(), F.col("same").isNotNull()
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.when(own, F.col("own.says")).when(same, F.col("same.says")).when(F.col("bad"), "block").otherwise("allow").alias("verdict"),
        F.when(own, "rule").when(same | F.col("bad"), "alias").otherwise("none").alias("by"),
    )
