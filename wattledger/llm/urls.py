"""URL filters with redirect equivalence.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and the longest fitting rule
decides. Pages without a fitting rule take the decision of their aliases: pages joined by redirects
(``<meta http-equiv="refresh">``) and canonical links form components, an explicit allow anywhere in the
component wins over a block, and a component without any decision is allowed.

Results: null urls and urls without ``://`` have empty host and path, fit no rule and have no aliases, so they
are allowed; null html has no edges; repeated rows are judged alike; character references in link values are
undone as in HTML attributes; relative links are resolved against the page's url, and the segments ``.`` and ``..``
of paths are taken out before urls are compared (rules see the path as it is); links to urls outside the table
count, as they may join two pages; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm.common import Scratch
from wattledger.llm.components import connected_components

Rule = tuple[str, str, str]  # verdict, host, start of the path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = r"(?s)^.*?://([^/?#]*)([^?#]*)"  # host and path after the first ://
LINK_TAG, IS_CANONICAL = r"(?is)<link\b[^>]*>", r"(?is)\brel\s*=\s*[\"']?canonical\b"
META_TAG, IS_REFRESH = r"(?is)<meta\b[^>]*>", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*;?))")
# a delay and the target, or the target alone after url=
TARGET = re.compile(r"""(?is)\s*(?:[\d.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?|[\s;,]*url\s*=\s*)(?:"([^"]*)|'([^']*)|(.*))""")
DOTS = r"/\.\.?(/|$)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), REST, 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), REST, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (host and path together), else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def unescaped(value: str) -> str:
    """An attribute's value without character references; a name without ``;`` before ``=`` is no reference."""

    def decoded(m: re.Match) -> str:
        if m[1] is None:
            return markup.unescape(m[0])
        if not m[1].endswith(";") and value[m.end() : m.end() + 1] == "=":
            return m[0]
        return html5.get(m[1], m[0])

    return REFERENCE.sub(decoded, value) if "&" in value else value


def target_of(tag: str) -> str:
    """Where a canonical link's or a refresh's tag points to; empty if nowhere."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), unescaped(m[2] or m[3] or m[4] or ""))
    if tag[:5].lower() == "<link":
        target = found.get("href", "")
    else:
        m = TARGET.match(found.get("content", ""))
        target = (m[1] or m[2] or m[3] or "") if m else ""
        target = target or found.get("url", "")
    return re.sub(r"[\t\r\n]", "", target).strip()


def without_dots(path: Column) -> Column:
    """A path without the segments ``.`` and ``..``."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, part: F.when(part == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
        .when(part == ".", out).otherwise(F.concat(out, F.array(part))),
    )
    # a dot segment at the end leaves the folder
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(DOTS), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def node_of(url: Column) -> Column:
    """The url without scheme, fragment, dot segments and case of the host; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", "/").otherwise(without_dots(path_of(url))), query))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from every page's node to the nodes its canonical link and its redirect point to."""
    own, text = F.col(url), F.coalesce(F.col(html), F.lit(""))
    def tags(tag: str, kind: str) -> Column:
        return F.filter(F.regexp_extract_all(text, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))

    def run(batches):
        for batch in batches:
            targets = pa.array([target_of(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), targets], ["own", "target"])

    # the patterns run only where their word occurs at all
    low, none = F.lower(text), F.array().cast("array<string>")
    found = F.array_distinct(
        F.concat(
            F.when(low.contains("canonical"), tags(LINK_TAG, IS_CANONICAL)).otherwise(none),
            F.when(low.contains("http-equiv"), tags(META_TAG, IS_REFRESH)).otherwise(none),
        )
    )
    link = F.col("target")
    scheme = F.coalesce(F.nullif(F.regexp_extract("own", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")), F.lit("http"))
    base = F.concat(scheme, F.lit("://"), host_of(F.col("own")))
    folder = F.regexp_replace(F.when(path_of(F.col("own")) == "", "/").otherwise(path_of(F.col("own"))), r"[^/]*$", "")
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.rlike(r"^[#?]"), F.concat(base, path_of(F.col("own")), link))
        .otherwise(F.concat(base, folder, link))
    )
    tagged = pages.where(host_of(own) != "").select(own.alias("own"), F.explode(found).alias("tag"))
    rows = tagged.mapInArrow(run, "own string, target string").where("target <> ''")
    return (
        rows.select(node_of(F.col("own")).alias("a"), node_of(full).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )


def judge(
    spark: SparkSession, pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, own = fitting_rule(host, path, rules)
    judged = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), own.alias("own"),
        node_of(F.col(url)).alias("node"),
    )
    scratch = Scratch(spark, "urls")
    edges = scratch.keep(link_edges(pages, url, html), "edges")
    labels = connected_components(edges, scratch)  # node, component: only nodes with edges
    # the decision of a component: nodes are judged by their own rules, whether pages of the table or only linked
    node_host = F.substring_index("node", "/", 1)
    node_path = F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)
    _, decision = fitting_rule(node_host, node_path, rules)
    verdicts = (
        labels.select("component", decision.alias("decision"))
        .where(F.col("decision").isNotNull())
        .groupBy("component")
        .agg(F.min("decision").alias("alias_verdict"))  # allow < block
    )
    by_node = labels.join(verdicts, "component").select("node", "alias_verdict")
    verdict = F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict")
    return judged.join(by_node, "node", "left").select("page_id", "host", "path", "rule", verdict)
