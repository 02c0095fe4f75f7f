"""Block and allow rules for URLs, carried to aliases over redirects and canonical links.

A rule is a host and the beginning of a path. It fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's; of several the longest decides (of equally long ones an allow, then the larger in code points).
Rules up to CHAIN are a chain of conditions in the row; more are a table that the URLs' host suffixes, cut to the labels
that rules have, are joined with.

URLs that no rule names are judged by their aliases. A page's canonical link and its refresh redirect are edges between
URLs, and so are redirects given besides; pages that have neither word in their markup are not parsed. The connected
components of these edges, found by label propagation with pointer jumping over 128-bit digests of URLs, are the
equivalence classes. A block of one member, whether it is a page of the table or only named by an edge, reaches all
members but those that a rule allows itself: explicit allows have precedence, and don't travel. What is not reached is
allowed.

Only URLs of edges take part in the components, so the work there grows with redirects, not with pages. Pages are not
grouped by host or URL; a bitmap holds back those whose URL may be a blocked alias, and only they are joined.

Defined results: a null URL, or one without "://", has an empty host and path, no rule and no aliases. As aliases, URLs
are compared by scheme, host (both with A-Z lower-cased), path (empty: /) and query; the fragment is left out. Links are
resolved against the page's base element or URL; those that are malformed or lead to themselves count for nothing, and so
do tags in comments, scripts, styles, titles and text areas. Rows that repeat a page are judged each. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import _marked, ascii_lower, materialize, slices
from inkwell.llm.near_dup import components

#: Rules that are conditions in the row, and rules that are broadcast as a table; beyond, the join is left to adaptive execution.
CHAIN, BROADCAST_RULES = 64, 50_000

#: What is read over, or a tag that links (its name and attributes). An end that is missing is the end of the text.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea|xmp)\b.*?(?:</\1\b|\Z)|<(link|meta|base)(?=[\s/>])((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+)))?""")
_REFRESH = re.compile(r"""\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def alias_key(url: Column) -> Column:
    """128-bit digest of what identifies a URL; null without "://"."""
    part = lambda i: F.regexp_extract(url, r"(?s)\A(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(F.contains(url, F.lit("://")), F.unhex(F.md5(F.concat(ascii_lower(F.concat(part(1), F.lit("://"), part(2))), path, part(4)))))


def parsed_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(rule, host, path, action) of (action, rule), the deciding ones first. A rule that is both is an allow."""
    known: dict[str, str] = {}
    for action, rule in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"no action: {action}")
        known[rule] = "allow" if "allow" in (action, known.get(rule)) else "block"
    rows = []
    for rule, action in known.items():
        host, slash, path = rule.partition("/")
        rows.append((rule, host, slash + path, action))
    return sorted(rows, key=lambda r: (len(r[0]), r[3] == "allow", r[0].encode()), reverse=True)


def _chained(rows: DataFrame, parsed: list[tuple[str, str, str, str]]) -> DataFrame:
    rule = F.lit(None).cast("string")
    action = F.lit(None).cast("string")
    for name, host, path, what in reversed(parsed):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path)) & F.col("known")
        rule, action = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rows.withColumns({"rule": rule, "action": action})


def _joined(rows: DataFrame, parsed: list[tuple[str, str, str, str]], broadcast: int) -> DataFrame:
    """The same by a table of rules: the places of distinct hosts and paths are looked up once each."""
    table = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(parsed)], "place int, rule string, rule_host string, rule_path string, action string")
    deep = max(r[1].count(".") + 1 for r in parsed)
    place = materialize(rows.filter("known").select("host", "path").distinct(), "places")
    suffixes = place.withColumn("suffix", F.explode(F.array_distinct(F.array(*(F.substring_index("host", ".", -i) for i in range(1, deep + 1))))))
    found = suffixes.join(F.broadcast(table) if len(parsed) <= broadcast else table, F.col("suffix") == F.col("rule_host")).filter(F.startswith("path", F.col("rule_path")))
    best = materialize(found.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), "place").alias("best")), "ruled")
    key = lambda h, p: F.md5(F.concat(h, F.lit("\n"), p))
    keyed = rows.withColumn("__key", F.when(F.col("known"), key(F.col("host"), F.col("path"))))
    out = keyed.join(best.select(key(F.col("host"), F.col("path")).alias("__key"), "best"), "__key", "left")
    return out.withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("__key", "best")


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str]], chain: int = CHAIN, broadcast: int = BROADCAST_RULES) -> DataFrame:
    """rows with a url, and host, path, rule and action (both null without a rule) for it."""
    parsed = parsed_rules(rules)
    host, path = host_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path, "known": F.coalesce(F.contains("url", F.lit("://")), F.lit(False))})
    return (_chained(rows, parsed) if len(parsed) <= chain else _joined(rows, parsed, broadcast)).drop("known")


def link_targets(url: str, text: str) -> list[str]:
    """The absolute targets of a page's canonical links and refresh redirects."""
    base, found = url, []
    for tag in _TAG.finditer(text):
        if tag[2] is None:
            continue
        given: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(tag[3]):
            given.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or "").strip())
        kind, target = tag[2].lower(), None
        if kind == "base" and "href" in given and base is url:
            base = _absolute(url, given["href"]) or url
        elif kind == "link" and "canonical" in given.get("rel", "").lower().split():
            target = given.get("href")
        elif kind == "meta" and given.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(given.get("content", ""))):
            target = (m[1] or m[2] or m[3] or "").strip()
        if target:
            found.append(target)
    return [t for t in (_absolute(base, f) for f in found) if t]


def _absolute(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link)
    except ValueError:  # such as a bracket in the host
        return None


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target): the URLs that pages (url, html) declare to be the same as their own."""
    may = pages.filter(F.contains("url", F.lit("://")) & F.col("html").rlike("(?i)<link[^a-z]|<meta[^a-z]") & F.col("html").rlike("(?i)canonical|refresh")).select("url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pairs = [(u, t) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True) for t in link_targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["source", "target"])

    return may.mapInArrow(run, "source string, target string")


def blocked_aliases(edges: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, alias_rule): the digests of all URLs of edges (source, target) whose class has a blocked member, and the
    smallest rule that blocks one."""
    keyed = materialize(edges.select("source", "target", alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")).filter("a <> b").distinct(), "aliases")
    names = keyed.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("source").alias("url")), F.struct(F.col("b").alias("key"), F.col("target").alias("url")))).alias("n")).select("n.*")
    blocked = with_rules(names, rules).filter("action = 'block'").groupBy("key").agg(F.min("rule").alias("rule"))
    reached = components(keyed.select("a", "b").distinct())
    hit = reached.join(blocked, reached.cls == blocked.key).groupBy(F.col("component").alias("c")).agg(F.min("rule").alias("alias_rule"))
    return reached.join(hit, reached.component == hit.c).select(F.col("cls").alias("key"), "alias_rule")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, chain: int = CHAIN) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_rule (what blocks an alias of a page that no rule names).

    redirects: further edges (source, target), such as those a crawler followed."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    aliases = materialize(blocked_aliases(edges, rules), "blocked")
    rows = with_rules(pages.select("page_id", "url"), rules, chain)
    rows = _marked(rows.withColumn("key", F.when(F.col("rule").isNull(), alias_key(F.col("url")))), "key", aliases.select("key"))
    doubt = rows.filter("__hit").join(aliases, "key", "left").select("page_id", "host", "path", "rule", "action", "alias_rule")
    clear = rows.filter("NOT __hit").select("page_id", "host", "path", "rule", "action", F.lit(None).cast("string").alias("alias_rule"))
    verdict = F.coalesce("action", F.when(F.col("alias_rule").isNotNull(), F.lit("block")), F.lit("allow"))
    return clear.unionByName(doubt).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_rule")
