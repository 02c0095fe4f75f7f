"""One registered query for each operation of the library, over the given tables, with its SQL where there is one.

The tables stand in for a documentation store: documents are the chunks of one document each (version: lang, category:
source, status from labels.toxic), embeddings are their vectors, benchmark texts the queries, pages the snapshot."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import markdown, urls, vectors
from inkwell.functions.encoders import WordLengthEncoder
from inkwell.operators import bm25, catalog, chunking, evaluation, fusion, html, ingest, linkgraph, querylog, rerank, text_index, vector_search
from inkwell.plans import workflows
from inkwell.sources import files as storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AT = "2024-01-02 03:04:05"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. The texts of one that is so small that it has one row group, which one task reads, are dealt out to all
    cores; tables of many row groups are read where they are."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in ("documents", "pages") and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism // 2:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


# ---- stand-ins for the store ----------------------------------------------------------------------------------------

SQL_STORE = """
    docs AS (SELECT d.doc_id AS id, concat('Title ', d.doc_id) AS title, lang AS target_version, source AS category, concat('docs/', source, '/', d.doc_id, '.md') AS source_path,
                    concat('https://docs.example.org/', lang, '/', d.doc_id, '/') AS source_url, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'Inactive' ELSE 'Active' END AS status, text
             FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Title "), "doc_id").alias("title"),
        F.col("lang").alias("target_version"),
        F.col("source").alias("category"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("source_path"),
        F.concat(F.lit("https://docs.example.org/"), "lang", F.lit("/"), "doc_id", F.lit("/")).alias("source_url"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "Inactive").otherwise("Active").alias("status"),
        "text",
    )
    sections = docs.select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("document_id"), F.col("category").alias("title"), F.lit(1).alias("level"), F.lit(0).alias("order"))
    chunks = docs.select("id", F.concat(F.lit("s"), "id").alias("section_id"), F.col("id").alias("document_id"), F.col("text").alias("content"), F.col("category").alias("section_title"))
    return {"documents": docs.drop("text"), "sections": sections, "chunks": chunks}


def index_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return bm25.build_index(store(spark, sf_dir)["chunks"].withColumnRenamed("id", "chunk_id"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query; its vector is the one with its number."""
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vec, "query_id", "left")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


# ---- URLs, paths, files ---------------------------------------------------------------------------------------------

_ABS = "regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"
_BARE = "regexp_replace(url, '[?#].*$', '')"
SQL_NORMAL = f"CASE WHEN {_ABS} THEN concat(lower(regexp_extract({_BARE}, '^([^:]+):', 1)), regexp_extract({_BARE}, '^[^:]+(:.*)$', 1)) ELSE url END"


@query("u1_normalize_url", f"SELECT page_id, {SQL_NORMAL} AS url FROM pages")
def u1(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("url"))


@query("u2_target_filter", "SELECT page_id, url LIKE 'https:%' AND NOT url LIKE 'https://on%' AND NOT url LIKE 'https://th%' AS is_target FROM pages")
def u2(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.is_target_url("url", "https://", ["https://on", "https://th"]).alias("is_target"))


SQL_PATH = f"regexp_replace(regexp_replace({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/]*', '')"


@query(
    "u3_file_path",
    f"""WITH p AS (SELECT page_id, {SQL_PATH} AS path FROM pages),
             q AS (SELECT page_id, path, ltrim(CASE WHEN starts_with(path, '/en/') THEN substr(path, 5) ELSE path END, '/') AS rest FROM p),
             r AS (SELECT page_id, path, regexp_replace(regexp_replace(rest, '/+', '/', 'g'), '/$', '') AS name FROM q)
        SELECT page_id, CASE WHEN name = '' THEN '_root_.md' WHEN name LIKE '%.md' THEN name WHEN name LIKE '%.html' AND NOT path LIKE '%/' THEN concat(substr(name, 1, length(name) - 5), '.md') ELSE concat(name, '.md') END AS rel_path FROM r""",
)
def u3(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.file_path("url", ".md", "/en/").alias("rel_path"))


@query("u4_path_url", "SELECT doc_id, concat('https://docs.example.org/en/', source, '/', CASE WHEN lang = 'en' THEN '' ELSE concat(doc_id, '.html') END) AS url FROM documents")
def u4(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.when(F.col("lang") == "en", "_root_.html").otherwise(F.concat("doc_id", F.lit(".html"))))
    return read(spark, sf_dir, "documents").select("doc_id", urls.path_url(path, "https://docs.example.org/en/").alias("url"))


@query("u5_inject_source_url", """SELECT page_id, length(html) + length(replace(url, '&', '&amp;')) + 36 AS n_chars, strpos(html, '<head>') + 6 AS at FROM pages""")
def u5(spark, sf_dir):
    made = read(spark, sf_dir, "pages").withColumn("made", urls.with_source_meta("html", "url"))
    return made.select("page_id", F.length("made").cast("long").alias("n_chars"), F.expr("locate('<meta content=', made)").cast("long").alias("at"))


@query("u6_recover_source_url", "SELECT page_id, CASE WHEN html LIKE '%lang=\"en\"%' THEN url ELSE concat('https://docs.example.org/en/', page_id, '.html') END AS url FROM pages")
def u6(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    page = F.when(F.contains("html", F.lit('lang="en"')), urls.with_source_meta("html", "url")).otherwise(F.col("html"))
    return pages.select("page_id", urls.recovered_url(page, F.concat("page_id", F.lit(".html")), "https://docs.example.org/en/").alias("url"))


@query("u7_doc_path_url", "SELECT doc_id, concat('https://docs.example.org/en/5.2/', source, '/', doc_id, '/') AS url FROM documents")
def u7(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", urls.doc_path_url(F.concat("source", F.lit("\\"), "doc_id", F.lit(".txt")), "https://docs.example.org/en/5.2").alias("url"))


@query("u8_listing_files", "SELECT page_id, regexp_matches(lower(regexp_extract(url, '([^/\\\\]*)$', 1)), 'index|latest|toc|genindex') AS is_listing FROM pages")
def u8(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.is_listing("url").alias("is_listing"))


@query("u9_html_pages", "SELECT page_id FROM pages WHERE url LIKE '%.html%' AND length(html) > 0")
def u9(spark, sf_dir):
    kind = F.when(F.contains("url", F.lit(".html")), "text/html; charset=utf-8").otherwise("application/pdf")
    return read(spark, sf_dir, "pages").filter(urls.is_html_page(kind, "html")).select("page_id")


@query("s1_html_snapshot", "SELECT concat(page_id % 7, '/', page_id, '.html') AS rel_path, md5(html) AS digest FROM pages WHERE html IS NOT NULL")
def s1(spark, sf_dir):
    path = storage.work_folder(spark)
    name = F.concat(F.col("page_id") % 7, F.lit("/"), F.col("page_id"), F.lit(".html"))
    storage.write_text_files(read(spark, sf_dir, "pages").select(name.alias("rel_path"), F.col("html").alias("content")), path)
    return storage.read_html_snapshot(spark, path).select(F.regexp_extract("path", r"(\d+/\d+\.html)$", 1).alias("rel_path"), F.md5("html").alias("digest"))


@query("s3_s5_markdown_docs", "SELECT 'snapshot' AS source, lang AS target_version, concat(doc_id, '.md') AS rel_path, md5(text) AS digest FROM documents")
def s3(spark, sf_dir):
    path = storage.work_folder(spark)
    docs = read(spark, sf_dir, "documents").select(F.lit("snapshot").alias("source"), F.col("lang").alias("target_version"), F.concat("doc_id", F.lit(".md")).alias("rel_path"), F.col("text").alias("content"))
    storage.write_markdown_docs(docs.withColumn("content", F.lit("stale")), path)
    storage.write_markdown_docs(docs, path)
    return spark.read.parquet(path).select("source", "target_version", "rel_path", F.md5("content").alias("digest"))


@query("s4_store", f"WITH {SQL_STORE} SELECT 'documents' AS name, CAST(id AS VARCHAR) AS id, status AS value FROM docs UNION ALL SELECT 'sections', concat('s', id), category FROM docs UNION ALL SELECT 'chunks', CAST(id AS VARCHAR), md5(text) FROM docs")
def s4(spark, sf_dir):
    path = storage.work_folder(spark)
    storage.write_store(store(spark, sf_dir), path)
    back = storage.read_store(spark, path)
    values = {"documents": F.col("status"), "sections": F.col("title"), "chunks": F.md5("content")}
    parts = [back[n].select(F.lit(n).alias("name"), F.col("id").cast("string").alias("id"), v.alias("value")) for n, v in values.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "i4_publish",
    f"WITH {SQL_STORE} SELECT 'documents' AS name, CAST(id AS VARCHAR) AS id FROM docs UNION ALL SELECT 'sections', concat('s', id) FROM docs UNION ALL SELECT 'chunks', CAST(id AS VARCHAR) FROM docs WHERE target_version <> 'en'",
)
def i4_publish(spark, sf_dir):
    path, held = storage.work_folder(spark), store(spark, sf_dir)
    storage.publish_store(held, path, "first")
    storage.write_store(held, f"{path}/unfinished")
    now = storage.published_store(spark, path)
    english = now["documents"].filter("target_version = 'en'").select(F.col("id").alias("document_id"))
    storage.publish_store({**now, "chunks": now["chunks"].join(english, "document_id", "left_anti")}, path, "second")
    back = storage.published_store(spark, path)
    parts = [back[n].select(F.lit(n).alias("name"), F.col("id").cast("string").alias("id")) for n in storage.TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s6_json_log", "SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, md5(text) FROM conversations WHERE role <> 'user'")
def s6(spark, sf_dir):
    path, said = storage.work_folder(spark), read(spark, sf_dir, "conversations")
    storage.write_json_log(said.filter("role = 'user'"), path)
    storage.write_json_log(said.filter("role <> 'user'"), path)
    return spark.read.schema(said.schema).json(path).select("conv_id", "turn", F.md5("text").alias("digest"))


# ---- HTML and Markdown ----------------------------------------------------------------------------------------------


@query("t1_t3_t4_markdown")
def t1(spark, sf_dir):
    return html.convert_pages(read(spark, sf_dir, "pages")).select("page_id", "title", "markdown", "error")


@query("t2_title", "SELECT page_id, trim(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&')) AS title FROM pages")
def t2(spark, sf_dir):
    return html.convert_pages(read(spark, sf_dir, "pages")).select("page_id", "title")


@query("t5_squeeze_newlines", "SELECT page_id, md5(regexp_replace(regexp_replace(replace(html, '<', chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages")
def t5(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(markdown.squeeze_newlines(F.replace("html", F.lit("<"), F.lit("\n\n")))).alias("digest"))


SQL_FRONT = "concat('---', chr(10), 'source_url: https://docs.example.org/', doc_id, chr(10), 'title: \"', source, '\"', chr(10), 'target_version: ', lang, chr(10), 'collected_at: 2024-01-02T03:04:05.000000+00:00', chr(10), '---', chr(10), chr(10), text)"


def fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = markdown.with_front_matter("text", F.concat(F.lit("https://docs.example.org/"), "doc_id"), "lang", F.lit(AT).cast("timestamp"), title="source")
    return read(spark, sf_dir, "documents").select("doc_id", "text", text.alias("content"))


@query("t6_front_matter", f"SELECT doc_id, md5({SQL_FRONT}) AS digest FROM documents")
def t6(spark, sf_dir):
    return fronted(spark, sf_dir).select("doc_id", F.md5("content").alias("digest"))


@query("s2_markdown_files", f"SELECT concat(doc_id, '.md') AS rel_path, md5({SQL_FRONT}) AS digest FROM documents WHERE text IS NOT NULL")
def s2(spark, sf_dir):
    """The files stand in subfolders, which are written and listed side by side; the names are the documents'."""
    path, folder = storage.work_folder(spark), F.pmod(F.col("doc_id"), F.lit(64))
    storage.write_text_files(fronted(spark, sf_dir).select(F.concat(folder, F.lit("/"), "doc_id", F.lit(".md")).alias("rel_path"), "content"), path)
    return storage.read_markdown(spark, path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("rel_path"), F.md5("content").alias("digest"))


@query("t7_parse_front_matter", "SELECT doc_id, source AS title, lang AS target_version, concat('https://docs.example.org/', doc_id) AS source_url, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def t7(spark, sf_dir):
    value = lambda k: markdown.front_matter_value("content", k).alias(k)
    return fronted(spark, sf_dir).select("doc_id", value("title"), value("target_version"), value("source_url"), F.md5(markdown.front_matter_body("content")).alias("digest"))


@query("t8_page_links", "WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT url AS src, concat(lower(regexp_extract(url, '^([^:]+)://', 1)), '://', regexp_extract(url, '^[^:]+://([^/?#]+)', 1), href) AS dst FROM l")
def t8(spark, sf_dir):
    return html.page_links(read(spark, sf_dir, "pages"))


SQL_ROLES = "text || repeat(chr(10), 4) || 'See [Guide](https://docs.example.org/en/5.2/intro/' || source || '/) and [DEBUG_' || upper(lang) || '](https://docs.example.org/en/5.2/ref/settings/#debug-' || lower(lang) || ') or `x` a_b'"
for _old, _new in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("~", ""), ("\\_", "_"), ("\\*", "*")):
    SQL_ROLES = f"replace({SQL_ROLES}, '{_old}', '{_new}')"


@query("t9_clean_roles", f"SELECT doc_id, regexp_replace(regexp_replace({SQL_ROLES}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def t9(spark, sf_dir):
    text = F.concat("text", F.lit("\n\n\n\nSee :doc:`Guide </intro/"), "source", F.lit(".txt>` and :setting:`DEBUG_"), F.upper("lang"), F.lit("` or :class:`~x` a\\_b"))
    return read(spark, sf_dir, "documents").select("doc_id", markdown.clean_roles(text, "https://docs.example.org/en/5.2").alias("text"))


@query("t10_conversion_stats", "SELECT regexp_extract(html, 'lang=\"(\\w+)\"', 1) AS source, count(*) AS pages, count(*) AS converted, CAST(0 AS BIGINT) AS failed FROM pages GROUP BY 1")
def t10(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").withColumn("source", F.regexp_extract("html", 'lang="(\\w+)"', 1))
    return html.conversion_stats(html.convert_pages(pages))


@query("t10_failing_pages", "SELECT regexp_extract(html, 'lang=\"(\\w+)\"', 1) AS source, count(*) AS pages, count(*) FILTER (WHERE page_id % 9 <> 4) AS converted, count(*) FILTER (WHERE page_id % 9 = 4) AS failed FROM pages GROUP BY 1")
def t10_failing(spark, sf_dir):
    """Some pages have lost their html, which the conversion reports."""
    pages = read(spark, sf_dir, "pages").withColumn("source", F.regexp_extract("html", 'lang="(\\w+)"', 1))
    return html.conversion_stats(html.convert_pages(pages.withColumn("html", F.when(F.col("page_id") % 9 != 4, F.col("html")))))


# ---- link graph -----------------------------------------------------------------------------------------------------


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and links of a tree over all pages: page i links to 2i + 1 and 2i + 2, whether they are there or not."""
    ids = read(spark, sf_dir, "pages").select("page_id")
    name = lambda c: F.concat(F.lit("https://t/"), c.cast("string"))
    links = ids.select(name(F.col("page_id")).alias("src"), F.explode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("d")).select("src", name(F.col("d")).alias("dst"))
    return ids.select(name(F.col("page_id")).alias("url")), links


SQL_VISITED = """RECURSIVE v(i, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT 2 * v.i + k.k, v.depth + 1 FROM v JOIN pages p ON p.page_id = v.i, (VALUES (1), (2)) AS k(k))"""


@query("g1_discover", f"WITH {SQL_VISITED} SELECT concat('https://t/', i) AS url, depth FROM v")
def g1(spark, sf_dir):
    return linkgraph.discover(tree(spark, sf_dir)[1], ["https://t/0"], "https://t/")


def site_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages, and the links they hold; every page of a site that is linked but not in the table leads back to the first
    page of its site, so that the links have cycles."""
    pages = read(spark, sf_dir, "pages")
    site = lambda c: F.regexp_extract(c, "^([^:]+://[^/?#]+)", 1)
    links = html.page_links(pages)
    first = pages.groupBy(site("url").alias("site")).agg(F.min("url").alias("dst"))
    back = links.select(F.col("dst").alias("src")).distinct().withColumn("site", site("src")).join(first, "site").select("src", "dst")
    return pages.select("url"), links.unionByName(back)


_LINKS = "SELECT url, concat(lower(regexp_extract(url, '^([^:]+)://', 1)), '://', regexp_extract(url, '^[^:]+://([^/?#]+)', 1), unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS dst FROM pages"
SQL_SITES = f"""RECURSIVE l AS ({_LINKS}), f AS (SELECT regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS site, min(url) AS dst FROM pages GROUP BY 1),
             e AS (SELECT url AS src, dst FROM l UNION SELECT l.dst, f.dst FROM l JOIN f ON regexp_extract(l.dst, '^([^:]+://[^/?#]+)', 1) = f.site),
             g AS (SELECT src, dst FROM e WHERE NOT starts_with(dst, 'http://www.') AND NOT starts_with(dst, 'https://www.')),
             v(url, depth) AS (SELECT url, 0 FROM pages WHERE page_id IN (3, 5) OR page_id % 10 = 0 UNION SELECT g.dst, v.depth + 1 FROM v JOIN g ON g.src = v.url WHERE v.depth < 8),
             u AS (SELECT url, min(depth) AS depth FROM v GROUP BY url)"""


@query("g1_discover_sites", f"WITH {SQL_SITES} SELECT url, depth FROM u")
def g1_sites(spark, sf_dir):
    """From some pages over the pages' own links, with cycles; sites that begin with www are not entered."""
    seeds = read(spark, sf_dir, "pages").filter("page_id IN (3, 5) OR page_id % 10 = 0").select("url")
    return linkgraph.discover(site_links(spark, sf_dir)[1], seeds, "http", ["http://www.", "https://www."])


@query("g2_g3_site_pages", f"WITH {SQL_SITES} SELECT p.page_id, u.depth, (SELECT count(*) FROM u LEFT JOIN pages q ON q.url = u.url WHERE q.url IS NULL) AS failed FROM pages p JOIN u ON u.url = p.url")
def g2_sites(spark, sf_dir):
    """The pages that were visited, and of how many visited URLs the snapshot has none."""
    visited = g1_sites(spark, sf_dir)
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    failed = linkgraph.crawl_stats(visited, pages).select("failed")
    kept = linkgraph.keep_visited(pages, visited, "url").join(visited, "url")
    return kept.select("page_id", "depth").join(F.broadcast(failed))  # one row


@query("g2_crawl_stats", f"WITH {SQL_VISITED} SELECT count(p.page_id) AS ok, count(*) - count(p.page_id) AS failed FROM v LEFT JOIN pages p ON p.page_id = v.i")
def g2(spark, sf_dir):
    pages, links = tree(spark, sf_dir)
    return linkgraph.crawl_stats(linkgraph.discover(links, ["https://t/0"]), pages)


@query("g3_keep_visited", "SELECT doc_id FROM documents WHERE concat('https://t/', doc_id) IN (SELECT concat('https://t/', page_id) FROM pages)")
def g3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://t/"), "doc_id").alias("source_url"))
    return linkgraph.keep_visited(docs, tree(spark, sf_dir)[0]).select("doc_id")


@query("g4_dedupe_by_content", "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents GROUP BY 2")
def g4(spark, sf_dir):
    return linkgraph.dedupe_by_content(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "content_hash")


# ---- chunking -------------------------------------------------------------------------------------------------------


@query("k1_k2_k3_k5_chunks")
def k1(spark, sf_dir):
    docs = html.convert_pages(read(spark, sf_dir, "pages"))
    return chunking.chunk_documents(docs, "page_id", "markdown")


@query("k4_header_context", "SELECT doc_id, CASE WHEN lang = 'en' AND source = 'src0' THEN 'Main' WHEN lang = 'en' THEN source WHEN source = 'src0' THEN lang ELSE concat(source, ' > ', lang) END AS header_context FROM documents")
def k4(spark, sf_dir):
    h1, h2 = F.when(F.col("source") != "src0", F.col("source")), F.when(F.col("lang") != "en", F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", chunking.header_context(h1, h2, F.lit(None).cast("string")).alias("header_context"))


@query("k6_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS word_count FROM documents")
def k6(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", markdown.word_count("text").alias("word_count"))


@query("k7_chunk_quality", "SELECT count(*) AS n_chunks, CAST(0 AS BIGINT) AS odd_fences, count(*) FILTER (WHERE length(text) > 1500) AS too_long, count(*) FILTER (WHERE source = 'src0') AS without_header, count(*) FILTER (WHERE regexp_matches(text, '(?m)^(Document|Context):')) AS injected FROM documents")
def k7(spark, sf_dir):
    context = F.when(F.col("source") == "src0", "Main").otherwise(F.col("source"))
    return chunking.chunk_quality(read(spark, sf_dir, "documents").select(F.col("text").alias("content"), context.alias("header_context")))


# ---- vectors --------------------------------------------------------------------------------------------------------


@query("e1_embed")
def e1(spark, sf_dir):
    return vector_search.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), workflows.default_encoder(), "text", 16).drop("text")


@query("e2_l2_normalize", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v) SELECT vec_id, list_transform(e, lambda x: round(CASE WHEN len > 0 THEN x / len ELSE 0 END, 6)) AS unit FROM n")
def e2(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(vectors.l2_normalize("embedding"), lambda x: vectors.rounded(x, 6)).alias("unit"))


def packed(spark: SparkSession, sf_dir: str, kind: str = "int8") -> DataFrame:
    """Every embedding as four token vectors, the first eight components of each packed."""
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.pack_tokens(8, kind)(vectors.split_tokens("embedding", 4)).alias("multi"))


SQL_TOKENS = """tok AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS t, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    sl AS (SELECT vec_id, t, list_slice(e, 16 * t + 1, 16 * t + 8) AS x FROM tok),
    tk AS (SELECT vec_id, t, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS u, list_transform(x, lambda y: CAST(CAST(y / sqrt(list_dot_product(x, x)) AS FLOAT) AS DOUBLE)) AS f FROM sl)"""


@query("e3_e4_e5_pack", f"WITH {SQL_TOKENS} SELECT vec_id, concat('0400', string_agg(array_to_string(list_transform(u, lambda y: printf('%02X', CAST((CAST(trunc(y * 127) AS INTEGER) + 256) % 256 AS INTEGER))), ''), '' ORDER BY t)) AS packed FROM tk GROUP BY vec_id")
def e3(spark, sf_dir):
    return packed(spark, sf_dir).select("vec_id", F.hex("multi").alias("packed"))


@query("e6_unpack", f"WITH {SQL_TOKENS} SELECT vec_id, CAST(t AS INTEGER) AS token, list_transform(f, lambda y: round(y, 6)) AS values FROM tk")
def e6(spark, sf_dir):
    rows = packed(spark, sf_dir, "float32").select("vec_id", F.posexplode(vectors.unpack_tokens(8, "float32")("multi")).alias("token", "v"))
    return rows.select("vec_id", "token", F.transform("v", lambda x: vectors.rounded(x, 6)).alias("values"))


# ---- ingestion ------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fronted(spark, sf_dir).select("doc_id", "content")
    return docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("source_path"), "content", F.lit("1.0").alias("default_version"), F.lit("Guide").alias("default_category"), F.col("doc_id").alias("seq"))


@query("i1_documents", "SELECT sha256(concat('docs/', doc_id, '.md', chr(31), lang)) AS id, source AS title, lang AS target_version, 'Guide' AS category, concat('docs/', doc_id, '.md') AS source_path, concat('https://docs.example.org/', doc_id) AS source_url, 'Active' AS status FROM documents")
def i1(spark, sf_dir):
    return ingest.build_documents(files(spark, sf_dir), F.lit(AT).cast("timestamp")).select("id", "title", "target_version", "category", "source_path", "source_url", "status")


SQL_SECTIONS = "first AS (SELECT conv_id AS document_id, role AS header_context, min(turn) AS f FROM conversations GROUP BY 1, 2), sections AS (SELECT sha256(concat(document_id, chr(31), header_context)) AS id, document_id, header_context AS title, 1 AS level, CAST(row_number() OVER (PARTITION BY document_id ORDER BY f, header_context) - 1 AS INTEGER) AS \"order\" FROM first)"


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("role").alias("header_context"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))


@query("i2_sections", f"WITH {SQL_SECTIONS} SELECT * FROM sections")
def i2(spark, sf_dir):
    return ingest.build_sections(conversation_chunks(spark, sf_dir)).drop("header_context")


@query("i3_chunks", f"WITH {SQL_SECTIONS} SELECT sha256(concat(conv_id, chr(31), turn)) AS id, s.id AS section_id, conv_id AS document_id, text AS content, s.title AS section_title, turn AS overlap_index FROM conversations c JOIN sections s ON c.conv_id = s.document_id AND c.role = s.title")
def i3(spark, sf_dir):
    chunks = conversation_chunks(spark, sf_dir)
    return ingest.build_chunks(chunks, ingest.build_sections(chunks))


@query(
    "i4_upsert",
    f"""WITH {SQL_STORE}, e AS (SELECT * FROM docs WHERE target_version <> 'de'), n AS (SELECT id + 1000000 AS id, source_path, target_version FROM docs WHERE target_version <> 'en'),
             d AS (SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source_path = e.source_path AND n.target_version = e.target_version) UNION ALL SELECT id FROM n)
        SELECT 'documents' AS name, id AS document_id FROM d UNION ALL SELECT 'sections', id FROM d UNION ALL SELECT 'chunks', id FROM d""",
)
def i4(spark, sf_dir):
    held = store(spark, sf_dir)
    old = {"documents": held["documents"].filter("target_version <> 'de'")}
    new = {"documents": held["documents"].filter("target_version <> 'en'").withColumn("id", F.col("id") + 1000000)}
    for name in ("sections", "chunks"):
        old[name] = held[name].join(old["documents"].select(F.col("id").alias("document_id")), "document_id", "left_semi")
        new[name] = held[name].withColumn("document_id", F.col("document_id") + 1000000).join(new["documents"].select(F.col("id").alias("document_id")), "document_id", "left_semi")
    made = ingest.upsert(old, new)
    rows = [made[n].select(F.lit(n).alias("name"), F.col(c).alias("document_id")) for n, c in (("documents", "id"), ("sections", "document_id"), ("chunks", "document_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("i5_last_wins", "SELECT source AS source_path, lang AS target_version, max(doc_id) AS seq FROM documents GROUP BY 1, 2")
def i5(spark, sf_dir):
    return ingest.last_wins(read(spark, sf_dir, "documents").select(F.col("source").alias("source_path"), F.col("lang").alias("target_version"), F.col("doc_id").alias("seq")))


@query(
    "i6_work_list",
    f"""WITH {SQL_STORE}, g AS (SELECT source_path, target_version FROM docs WHERE target_version = 'fr'), t AS (SELECT source_path, target_version FROM docs WHERE status = 'Active' AND target_version <> 'es')
        SELECT source_path, target_version FROM g UNION SELECT source_path, target_version FROM t""",
)
def i6(spark, sf_dir):
    docs = store(spark, sf_dir)["documents"]
    given = docs.filter("target_version = 'fr'")
    return ingest.work_list(given, docs, docs.filter("target_version <> 'es'").select("source_path")).select("source_path", "target_version")


@query("i7_reingest", f"WITH {SQL_STORE} SELECT id, source_path, target_version AS default_version, category AS default_category, target_version <> 'es' AS found FROM docs WHERE status = 'Inactive'")
def i7(spark, sf_dir):
    held = store(spark, sf_dir)
    files = held["documents"].filter("target_version <> 'es'").select("source_path", F.lit("# x").alias("content"))
    return ingest.reingest_files(held["documents"], held["documents"].filter("status = 'Inactive'"), files).drop("content")


_FAILS = "regexp_matches(text, '[^\\s]*tha[^\\s]*')"


def text_ingest(spark: SparkSession, sf_dir: str, chunk_size: int = 1500) -> dict[str, DataFrame]:
    """All documents as files, with an encoder that refuses words with tha."""
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("source_path"), F.col("text").alias("content"), F.coalesce("lang", F.lit("xx")).alias("default_version"), F.col("source").alias("default_category"), F.col("doc_id").alias("seq"))
    return workflows.ingest(files, F.lit(AT).cast("timestamp"), lambda: WordLengthEncoder(16, "tha"), chunk_size=chunk_size, low=16)


@query(
    "i8_failing_encoder",
    f"""WITH d AS (SELECT concat('d/', doc_id, '.md') AS source_path, {_FAILS} AS fails, regexp_matches(text, '\\S') AS words FROM documents)
        SELECT 'documents' AS name, source_path FROM d WHERE NOT fails UNION ALL SELECT 'sections', source_path FROM d WHERE NOT fails AND words
        UNION ALL SELECT 'chunks', source_path FROM d WHERE NOT fails AND words UNION ALL SELECT 'quarantine', source_path FROM d WHERE fails""",
)
def i8_failing(spark, sf_dir):
    """An encoder that fails on some chunks withholds their documents, and nothing else, from all tables."""
    made = text_ingest(spark, sf_dir)
    docs = made["documents"].select(F.col("id").alias("document_id"), "source_path")
    parts = [made["documents"].select(F.lit("documents").alias("name"), "source_path"), made["quarantine"].select(F.lit("quarantine").alias("name"), "source_path")]
    # rows of a withheld document would be left over here
    parts += [made[n].select("document_id").distinct().join(docs, "document_id", "left").select(F.lit(n).alias("name"), "source_path") for n in ("sections", "chunks")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("i10_run_summary", f"WITH d AS (SELECT {_FAILS} AS fails, regexp_matches(text, '\\S') AS words FROM documents) SELECT count(*) AS total, count(*) FILTER (WHERE NOT fails) AS successful, count(*) FILTER (WHERE fails) AS failed, count(*) FILTER (WHERE NOT fails AND words) AS chunks FROM d")
def i10_run(spark, sf_dir):
    """The summary of a run with failures; chunks are long enough for any document."""
    made = text_ingest(spark, sf_dir, 1_000_000)
    return ingest.ingest_summary(ingest.file_results(made["documents"], made["chunks"], made["quarantine"]))


@query("e1_word_lengths", "WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: least(len(x), 16)) AS n FROM documents) SELECT doc_id, list_transform(range(1, 17), lambda i: CAST(len(list_filter(n, lambda x: x = i)) AS DOUBLE)) AS embedding, CAST(len(n) AS INTEGER) AS token_count, CAST(0 AS BIGINT) AS encoded_again FROM w")
def e1_once(spark, sf_dir):
    """Every text encoded once, copies from the vectors of the first; a second run over all of them encodes nothing."""
    path, docs, plain = storage.work_folder(spark), read(spark, sf_dir, "documents").select("doc_id", "text"), WordLengthEncoder
    none = vector_search.embed_new(docs.limit(0), docs.limit(0).select(F.col("text").alias("digest")), plain, "text", 16)
    half = vector_search.embed_new(docs.filter("doc_id % 2 = 0"), none, plain, "text", 16)
    half.write.parquet(path)
    vector_search.embed_new(docs, spark.read.schema(half.schema).parquet(path), plain, "text", 16).write.mode("append").parquet(path)
    known = spark.read.schema(half.schema).parquet(path)
    again = vector_search.embed_new(docs, known, plain, "text", 16).agg(F.count(F.lit(1)).alias("encoded_again"))
    made = vector_search.with_vectors(docs, known, "text").select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "token_count")
    return made.join(F.broadcast(again))  # one row


@query(
    "i4_upsert_store",
    f"""WITH {SQL_STORE}, e AS (SELECT * FROM docs WHERE target_version <> 'de'), n AS (SELECT id + 1000000 AS id, source_path, target_version FROM docs WHERE target_version <> 'en'),
             d AS (SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source_path = e.source_path AND n.target_version = e.target_version) UNION ALL SELECT id FROM n)
        SELECT 'documents' AS name, id AS document_id FROM d UNION ALL SELECT 'sections', id FROM d UNION ALL SELECT 'chunks', id FROM d""",
)
def i4_store(spark, sf_dir):
    """A stored table set, and new documents put into the parts of it that hold their keys."""
    held, path = store(spark, sf_dir), storage.work_folder(spark)
    sides = ({"documents": held["documents"].filter("target_version <> 'de'")}, {"documents": held["documents"].filter("target_version <> 'en'").withColumn("id", F.col("id") + 1000000)})
    for side, shift in zip(sides, (0, 1000000), strict=True):
        own = side["documents"].select(F.col("id").alias("document_id"))
        side |= {n: held[n].withColumn("document_id", F.col("document_id") + shift).join(own, "document_id", "left_semi") for n in ("sections", "chunks")}
        storage.upsert_store(spark, path, side)
    back = storage.published_store(spark, path)
    rows = [back[n].select(F.lit(n).alias("name"), F.col(c).alias("document_id")) for n, c in (("documents", "id"), ("sections", "document_id"), ("chunks", "document_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("i8_quarantine", "SELECT doc_id, length(text) < 100 AS failed FROM documents")
def i8(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") < 100, "too short").alias("error"))
    good, bad = ingest.quarantine(rows)
    return good.select("doc_id", F.lit(False).alias("failed")).unionByName(bad.select("doc_id", F.lit(True).alias("failed")))


@query("i9_key_violations", "SELECT source AS source_path, lang AS target_version, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def i9(spark, sf_dir):
    return ingest.key_violations(read(spark, sf_dir, "documents").select(F.col("source").alias("source_path"), F.col("lang").alias("target_version")))


@query("i10_ingest_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE length(text) >= 100) AS successful, count(*) FILTER (WHERE length(text) < 100) AS failed, CAST(coalesce(sum(ceil(length(text) / 1500)) FILTER (WHERE length(text) >= 100), 0) AS BIGINT) AS chunks FROM documents")
def i10(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_path"), F.when(F.length("text") < 100, "too short").alias("error"), F.ceil(F.length("text") / 1500).alias("n_chunks"))
    return ingest.ingest_summary(rows)


# ---- retrieval ------------------------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
SQL_INDEX = f"""
    w AS (SELECT doc_id AS chunk_id, 'content' AS field, {_WORDS.format("text")} AS words FROM documents UNION ALL SELECT doc_id, 'section_title', {_WORDS.format("source")} FROM documents),
    f AS (SELECT field, count(*) AS n, avg(len(words)) AS avg_length FROM w GROUP BY field),
    t AS (SELECT chunk_id, field, len(words) AS length, unnest(words) AS term FROM w),
    p AS (SELECT term, chunk_id, field, length, count(*) AS tf FROM t GROUP BY ALL),
    df AS (SELECT term, field, count(*) AS df FROM p GROUP BY ALL)"""
SQL_BM25 = f"""{SQL_INDEX},
    a AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark),
    sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * CASE WHEN p.field = 'content' THEN 1.0 ELSE 3.0 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
           FROM a JOIN p ON a.term = p.term JOIN df ON df.term = p.term AND df.field = p.field JOIN f ON f.field = p.field GROUP BY 1, 2),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""
SQL_VECTOR = """
    vq AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
    vs AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 6) AS similarity FROM vq, embeddings),
    ve AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM vs)"""
SQL_RRF = f"""{SQL_BM25}, {SQL_VECTOR},
    fu AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.chunk_id, v.chunk_id) AS chunk_id, b.rank AS bm25_rank, v.rank AS vector_rank,
                  coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS rrf_score
           FROM (SELECT * FROM bm WHERE rank <= 50) b FULL JOIN (SELECT * FROM ve WHERE rank <= 50) v ON b.query_id = v.query_id AND b.chunk_id = v.chunk_id),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS rank FROM fu)"""


@query("r1_prefilter", f"WITH {SQL_STORE} SELECT id, category AS section_title, title AS document_title, source_url FROM docs WHERE status = 'Active' AND target_version = 'en'")
def r1(spark, sf_dir):
    held = store(spark, sf_dir)
    return bm25.active_chunks(held["chunks"], held["sections"], held["documents"], "en", "All").select("id", "section_title", "document_title", "source_url")


@query("r2_index_terms", f"WITH {SQL_INDEX} SELECT term, p.field, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY ALL")
def r2(spark, sf_dir):
    return bm25.build_index(store(spark, sf_dir)["chunks"].withColumnRenamed("id", "chunk_id"))["terms"]


def words_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(index_of(spark, sf_dir), asked(spark, sf_dir), 50, digits=6)


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.vector_search(vectors_of(spark, sf_dir), asked(spark, sf_dir).filter("vector IS NOT NULL"), 50, digits=6)


@query("r3_bm25", f"WITH {SQL_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 50")
def r3(spark, sf_dir):
    return words_hits(spark, sf_dir)


@query(
    "r4_vector_search",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings v),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM s)
       SELECT query_id, chunk_id, similarity, rank FROM r WHERE rank <= 10""",
)
def r4(spark, sf_dir):
    held = vectors_of(spark, sf_dir)
    return vector_search.vector_search(held, held.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), 10, digits=6)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(words_hits(spark, sf_dir), vector_hits(spark, sf_dir))


@query("r5_rrf", f"WITH {SQL_RRF} SELECT query_id, chunk_id, CAST(bm25_rank AS INTEGER) AS bm25_rank, CAST(vector_rank AS INTEGER) AS vector_rank, round(rrf_score, 9) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM rr WHERE rank <= 50")
def r5(spark, sf_dir):
    return fused(spark, sf_dir).withColumn("rrf_score", F.round("rrf_score", 9))


@query("r6_hits", f"WITH {SQL_RRF}, {SQL_STORE} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, title AS document_title, target_version, md5(text) AS digest FROM rr JOIN docs ON docs.id = rr.chunk_id WHERE rank <= 50")
def r6(spark, sf_dir):
    held = store(spark, sf_dir)
    every = held["chunks"].select(F.col("id").alias("chunk_id"), "content").join(held["documents"].select(F.col("id").alias("chunk_id"), F.col("title").alias("document_title"), "target_version"), "chunk_id")
    return fusion.assemble_hits(fused(spark, sf_dir), every).select("query_id", "chunk_id", "rank", "document_title", "target_version", F.md5("content").alias("digest"))


def multi_hits(spark: SparkSession, sf_dir: str, kind: str = "int8", hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fused hits with the packed vectors of hits and queries."""
    multi = packed(spark, sf_dir, kind)
    hits = (fused(spark, sf_dir) if hits is None else hits).join(multi.select(F.col("vec_id").alias("chunk_id"), F.col("multi").alias("multi_vector_low_dim")), "chunk_id", "left").withColumn("similarity", F.col("rrf_score"))
    return hits, asked(spark, sf_dir).select("query_id").join(multi.select(F.col("vec_id").alias("query_id"), "multi"), "query_id", "left")


@query(
    "r7_maxsim",
    f"""WITH {SQL_RRF}, {SQL_TOKENS}, pr AS (SELECT query_id, chunk_id FROM rr WHERE rank <= 50),
             mx AS (SELECT pr.query_id, pr.chunk_id, a.t, max(list_dot_product(a.f, b.f)) AS best FROM pr JOIN tk a ON a.vec_id = pr.query_id LEFT JOIN tk b ON b.vec_id = pr.chunk_id GROUP BY 1, 2, 3)
        SELECT query_id, chunk_id, round(coalesce(avg(best), 0), 6) AS score FROM mx GROUP BY 1, 2""",
)
def r7(spark, sf_dir):
    hits, queries = multi_hits(spark, sf_dir, "float32")
    return hits.join(queries, "query_id").select("query_id", "chunk_id", F.round(vectors.maxsim(8, "float32")("multi", "multi_vector_low_dim"), 6).alias("score"))


SQL_RERANK = f"""{SQL_RRF}, {SQL_TOKENS},
    ti AS (SELECT vec_id, t, list_transform(u, lambda y: trunc(y * 127) / 127) AS i FROM tk),
    mx AS (SELECT rr.query_id, rr.chunk_id, a.t, max(list_dot_product(a.i, b.i)) AS best FROM rr JOIN ti a ON a.vec_id = rr.query_id LEFT JOIN ti b ON b.vec_id = rr.chunk_id WHERE rr.rank <= 50 GROUP BY 1, 2, 3),
    ms AS (SELECT query_id, chunk_id, bool_and(best IS NULL) AS lacks, round(coalesce(avg(best), 0), 6) AS s FROM mx GROUP BY 1, 2),
    k AS (SELECT rr.query_id, rr.chunk_id, rank, s AS rerank_score, round(CASE WHEN lacks THEN rrf_score ELSE s END, 9) AS similarity FROM rr JOIN ms ON ms.query_id = rr.query_id AND ms.chunk_id = rr.chunk_id WHERE lacks OR s >= 0.3),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS final_rank FROM k)"""


def reranked(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """The best five of the fused hits by MaxSim of packed int8 vectors, rounded before they are ranked."""
    hits, queries = multi_hits(spark, sf_dir, hits=hits)
    score = F.round(vectors.maxsim(8)("multi", "multi_vector_low_dim"), 6)
    hits = hits.join(queries, "query_id").withColumn("s", score).drop("multi")
    return rerank.rerank(hits, queries, dim=8, threshold=0.3, limit=5, score="s").filter("NOT rerank_failed")


@query("r8_rerank", f"WITH {SQL_RERANK} SELECT query_id, chunk_id, rerank_score, similarity, CAST(final_rank AS INTEGER) AS final_rank FROM o WHERE final_rank <= 5")
def r8(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "chunk_id", "rerank_score", F.round("similarity", 9).alias("similarity"), "final_rank")


@query(
    "r1_r11_per_query",
    f"""WITH {SQL_BM25}, {SQL_STORE},
             q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'All' END AS version, CASE item_id % 2 WHEN 0 THEN 'src1' ELSE '' END AS kind, 1 + item_id % 12 AS max_results FROM benchmark),
             h AS (SELECT sc.query_id, chunk_id, score, target_version, category, max_results, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, chunk_id) AS rank
                   FROM sc JOIN q ON q.query_id = sc.query_id JOIN docs ON docs.id = sc.chunk_id
                   WHERE status = 'Active' AND (coalesce(version, '') IN ('', 'All') OR target_version = version) AND (kind IN ('', 'All') OR category = kind))
        SELECT query_id, CAST(rank AS INTEGER) AS final_rank, target_version, category AS document_type, score AS relevance_score FROM h WHERE rank <= least(max_results, 10)""",
)
def r1_per_query(spark, sf_dir):
    held = store(spark, sf_dir)
    allowed = bm25.active_chunks(held["chunks"], held["sections"], held["documents"]).withColumnRenamed("id", "chunk_id")
    version = F.when(F.col("query_id") % 3 == 0, "en").when(F.col("query_id") % 3 == 1, "All")
    queries = asked(spark, sf_dir).select("query_id", "query", version.alias("target_version"), F.when(F.col("query_id") % 2 == 0, "src1").otherwise("").alias("category"), (1 + F.col("query_id") % 12).alias("max_results"))
    found = bm25.search(index_of(spark, sf_dir), queries, 10, allowed=allowed, digits=6)
    hits = found.join(allowed, "chunk_id").join(queries.select("query_id", "max_results"), "query_id").withColumn("rrf_score", F.col("score"))
    hits = hits.withColumns({"final_rank": F.col("rank"), "similarity": F.col("score"), "rerank_score": F.lit(None).cast("double"), "rerank_failed": F.lit(True)})
    return rerank.api_rows(hits, F.col("max_results")).select("query_id", "final_rank", "target_version", "document_type", "relevance_score")


@query("r3_stored_index", f"WITH {SQL_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 10")
def r3_stored(spark, sf_dir):
    """Three versions first, one of them with other texts; then an increment replaces that one and adds the others."""
    chunks = store(spark, sf_dir)["chunks"].select(F.col("id").alias("chunk_id"), "content", "section_title", F.col("id").alias("n"))
    early = chunks.filter("n % 5 <> 3").withColumn("content", F.when(F.col("n") % 5 == 2, F.lit("stale text")).otherwise(F.col("content")))
    index = text_index.create_index(early.drop("n"), storage.work_folder(spark))
    index = text_index.update_index(index, chunks.filter("n % 5 IN (2, 3)").drop("n"), early.limit(0).select("chunk_id"))
    return text_index.pruned_search(index, asked(spark, sf_dir), 10, digits=6, direct=2_000)


@query("r2_increments", f"WITH {SQL_INDEX} SELECT term, p.field, count(*) AS df FROM p WHERE chunk_id % 7 <> 1 GROUP BY ALL")
def r2_increments(spark, sf_dir):
    """An index of two thirds and stale texts, the rest and the right texts added, a seventh deleted."""
    chunks = store(spark, sf_dir)["chunks"].select(F.col("id").alias("chunk_id"), "content", "section_title")
    early = chunks.filter("chunk_id % 3 <> 0").withColumn("content", F.when(F.col("chunk_id") % 3 == 1, F.upper("section_title")).otherwise(F.col("content")))
    index = text_index.create_index(early, storage.work_folder(spark))
    index = text_index.update_index(index, chunks.filter("chunk_id % 3 <> 2"))
    index = text_index.update_index(index, chunks.limit(0), chunks.filter("chunk_id % 7 = 1").select("chunk_id"))
    return index.terms()


@query(
    "r1_r9_hybrid_filters",
    f"""WITH {SQL_INDEX}, {SQL_STORE},
             q AS (SELECT item_id AS query_id, text, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'All' END AS version, CASE item_id % 2 WHEN 0 THEN 'src1' ELSE '' END AS kind FROM benchmark),
             ok AS (SELECT q.query_id, docs.id AS chunk_id FROM q, docs WHERE status = 'Active' AND (coalesce(version, '') IN ('', 'All') OR target_version = version) AND (kind = '' OR category = kind)),
             a AS (SELECT DISTINCT query_id, unnest({_WORDS.format("text")}) AS term FROM q),
             sc AS (SELECT a.query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * CASE WHEN p.field = 'content' THEN 1.0 ELSE 3.0 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
                    FROM a JOIN p ON a.term = p.term JOIN df ON df.term = p.term AND df.field = p.field JOIN f ON f.field = p.field JOIN ok ON ok.query_id = a.query_id AND ok.chunk_id = p.chunk_id GROUP BY 1, 2),
             bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc),
             vs AS (SELECT ok.query_id, ok.chunk_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity FROM ok JOIN embeddings e ON e.vec_id = ok.query_id JOIN embeddings c ON c.vec_id = ok.chunk_id),
             ve AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM vs),
             fu AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.chunk_id, v.chunk_id) AS chunk_id, b.rank AS bm25_rank, v.rank AS vector_rank, coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS rrf_score
                    FROM (SELECT * FROM bm WHERE rank <= 20) b FULL JOIN (SELECT * FROM ve WHERE rank <= 20) v ON b.query_id = v.query_id AND b.chunk_id = v.chunk_id),
             rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS rank FROM fu)
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, CAST(vector_rank AS INTEGER) AS vector_rank, target_version, category FROM rr JOIN docs ON docs.id = rr.chunk_id WHERE rank <= 20""",
)
def r1_r9(spark, sf_dir):
    """Every query with a version and a category of its own, over words and vectors."""
    held = store(spark, sf_dir)
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = workflows.with_facets(held["chunks"], held["documents"]).join(vec, "chunk_id", "left")
    index, cells = workflows.index_chunks(chunks, storage.work_folder(spark))
    version = F.when(F.col("query_id") % 3 == 0, "en").when(F.col("query_id") % 3 == 1, "All")
    queries = asked(spark, sf_dir).withColumns({"target_version": version, "category": F.when(F.col("query_id") % 2 == 0, "src1").otherwise("")})
    hits = rerank.hybrid_search(index, cells, chunks.drop("embedding", "content"), queries, 20, fixed={"status": "Active"}, digits=6)
    return hits.select("query_id", "chunk_id", "rank", "bm25_rank", "vector_rank", "target_version", "category")


@query("r10_rerank_fallback", f"WITH {SQL_RRF} SELECT query_id, chunk_id, true AS rerank_failed, round(rrf_score, 9) AS similarity, CAST(rank AS INTEGER) AS final_rank FROM rr WHERE rank <= 5")
def r10(spark, sf_dir):
    hits, queries = multi_hits(spark, sf_dir)
    out = rerank.rerank(hits, queries.withColumn("multi", F.lit(None).cast("binary")), limit=5)
    return out.select("query_id", "chunk_id", "rerank_failed", F.round("similarity", 9).alias("similarity"), "final_rank")


@query(
    "r12_linear_fusion",
    f"""WITH {SQL_BM25}, {SQL_VECTOR},
             b AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1 END AS s FROM bm WHERE rank <= 50 WINDOW q AS (PARTITION BY query_id)),
             v AS (SELECT query_id, chunk_id, CASE WHEN max(similarity) OVER q > min(similarity) OVER q THEN (similarity - min(similarity) OVER q) / (max(similarity) OVER q - min(similarity) OVER q) ELSE 1 END AS s FROM ve WHERE rank <= 50 WINDOW q AS (PARTITION BY query_id))
        SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.chunk_id, v.chunk_id) AS chunk_id, round(0.5 * coalesce(b.s, 0) + 0.5 * coalesce(v.s, 0), 6) AS fused_score FROM b FULL JOIN v ON b.query_id = v.query_id AND b.chunk_id = v.chunk_id""",
)
def r12(spark, sf_dir):
    return fusion.linear_fusion(words_hits(spark, sf_dir), vector_hits(spark, sf_dir), limit=100).select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"))


# ---- catalogue ------------------------------------------------------------------------------------------------------


@query("c1_facets", "SELECT DISTINCT 'version' AS kind, lang AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT 'category', source FROM documents WHERE source IS NOT NULL")
def c1(spark, sf_dir):
    return catalog.facets(store(spark, sf_dir)["documents"])


@query("c2_set_status", f"WITH {SQL_STORE} SELECT id, CASE WHEN category = 'src1' THEN 'Inactive' ELSE status END AS status FROM docs")
def c2(spark, sf_dir):
    docs = store(spark, sf_dir)["documents"]
    return catalog.set_status(docs, docs.filter("category = 'src1'"), "Inactive").select("id", "status")


@query("c3_list_documents", f"WITH {SQL_STORE} SELECT id, title, target_version, category, status FROM docs WHERE target_version = 'en' AND status = 'Active'")
def c3(spark, sf_dir):
    return catalog.list_documents(store(spark, sf_dir)["documents"], "en", "All", "Active").select("id", "title", "target_version", "category", "status")


@query("c4_search_rows", "SELECT doc_id AS id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1'))")
def c4(spark, sf_dir):
    return catalog.search_rows(store(spark, sf_dir)["chunks"], "The SRC1", ["content", "section_title"]).select("id")


def gram_found(spark: SparkSession, rows: DataFrame, text: str, fields: list[str]) -> DataFrame:
    path = f"{storage.work_folder(spark)}/grams"
    catalog.write_gram_index(rows, fields, path)
    return catalog.gram_search(rows, spark.read.parquet(path), text, fields).select("id")


@query("c4_indexed_documents", f"WITH {SQL_STORE} SELECT id FROM docs WHERE (contains(lower(title), 'src1') OR contains(lower(source_path), 'src1')) AND (contains(lower(title), '7') OR contains(lower(source_path), '7'))")
def c4_documents(spark, sf_dir):
    return gram_found(spark, store(spark, sf_dir)["documents"], "SRC1 7", ["title", "source_path"])


@query("c4_indexed_sections", f"WITH {SQL_STORE} SELECT concat('s', id) AS id FROM docs WHERE (contains(lower(category), 'src') OR contains(lower(title), 'src')) AND (contains(lower(category), 'tle') OR contains(lower(title), 'tle')) AND (contains(lower(category), '12') OR contains(lower(title), '12'))")
def c4_sections(spark, sf_dir):
    held = store(spark, sf_dir)
    rows = held["sections"].join(held["documents"].select(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "document_id")
    return gram_found(spark, rows, "src TLE 12", ["title", "document_title"])


@query("c4_indexed_chunks", "SELECT doc_id AS id FROM documents WHERE contains(lower(concat(text, chr(1), source, chr(1), 'title ', doc_id)), 'thereth') AND contains(lower(concat(text, chr(1), source, chr(1), 'title ', doc_id)), 'src')")
def c4_chunks(spark, sf_dir):
    held = store(spark, sf_dir)
    rows = held["chunks"].join(held["documents"].select(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "document_id")
    return gram_found(spark, rows, "Thereth src", ["content", "section_title", "document_title"])


@query("c5_chunk_catalog", f"WITH {SQL_STORE} SELECT id, category AS section_title, title AS document_title, target_version FROM docs WHERE category = 'src2'")
def c5(spark, sf_dir):
    held = store(spark, sf_dir)
    return catalog.chunk_catalog(held["chunks"], held["sections"], held["documents"], category="src2").select("id", "section_title", "document_title", "target_version")


@query("c6_embedding_preview", "SELECT vec_id, concat('[', array_to_string(list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, 5), lambda x: printf('%.4f', x)), ', '), ', ... (', len(embedding), ' dims)]') AS preview FROM embeddings")
def c6(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.preview("embedding").alias("preview"))


@query("c7_document_sections", f"WITH {SQL_SECTIONS} SELECT title, \"order\" FROM sections WHERE document_id = 0")
def c7(spark, sf_dir):
    return catalog.document_sections(ingest.build_sections(conversation_chunks(spark, sf_dir)), 0).select("title", "order")


# ---- evaluation -----------------------------------------------------------------------------------------------------

#: The golden set: each benchmark text as a query, its first 40 characters as the expected keyword.
SQL_JUDGED = f"""{SQL_BM25},
    g AS (SELECT item_id AS query_id, substr(text, 1, 40) AS kw, CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS category FROM benchmark),
    hit AS (SELECT g.query_id, bm.rank, bm.chunk_id, contains(lower(d.text), lower(kw)) AS relevant FROM g JOIN bm ON bm.query_id = g.query_id JOIN documents d ON d.doc_id = bm.chunk_id WHERE bm.rank <= 5),
    j AS (SELECT g.query_id, g.category, coalesce(min(hit.rank) FILTER (WHERE relevant), 0) AS first_rank, count(*) FILTER (WHERE NOT relevant) AS false_positives FROM g LEFT JOIN hit ON g.query_id = hit.query_id GROUP BY 1, 2)"""
_MEASURES = "count(*) AS queries, round(avg(CASE WHEN first_rank > 0 THEN 1.0 / first_rank ELSE 0 END), 9) AS mrr, round(avg(CASE WHEN first_rank BETWEEN 1 AND 1 THEN 100.0 ELSE 0 END), 9) AS hit_at_1, round(avg(CASE WHEN first_rank BETWEEN 1 AND 3 THEN 100.0 ELSE 0 END), 9) AS hit_at_3, round(avg(CASE WHEN first_rank BETWEEN 1 AND 5 THEN 100.0 ELSE 0 END), 9) AS hit_at_5"


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.length("text") > 300, "long").otherwise("short")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.substring("text", 1, 40)).alias("expected_keywords"), kind.alias("category"))


def golden_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return texts.join(bm25.small(words_hits(spark, sf_dir).filter("rank <= 5")), "chunk_id")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.judge(golden(spark, sf_dir), golden_hits(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query("v1_keyword_relevance", f"WITH {SQL_JUDGED} SELECT query_id, chunk_id, relevant FROM hit")
def v1(spark, sf_dir):
    hits = golden_hits(spark, sf_dir).join(golden(spark, sf_dir), "query_id")
    return hits.select("query_id", "chunk_id", evaluation.keyword_relevance("content", "expected_keywords").alias("relevant"))


@query("v2_first_rank", f"WITH {SQL_JUDGED} SELECT query_id, CAST(first_rank AS INTEGER) AS first_rank FROM j")
def v2(spark, sf_dir):
    return judged(spark, sf_dir).select("query_id", "first_rank")


@query("v3_v5_measures", f"WITH {SQL_JUDGED} SELECT {_MEASURES} FROM j")
def v3(spark, sf_dir):
    return rounded(evaluation.measures(judged(spark, sf_dir)))


@query("v4_gate", f"WITH {SQL_JUDGED}, m AS (SELECT {_MEASURES} FROM j) SELECT mrr, hit_at_3, mrr >= 0.75 AND hit_at_3 >= 90 AS passed FROM m")
def v4(spark, sf_dir):
    return rounded(evaluation.gate(evaluation.measures(judged(spark, sf_dir)))).select("mrr", "hit_at_3", "passed")


@query("v6_by_category", f"WITH {SQL_JUDGED} SELECT category, {_MEASURES} FROM j GROUP BY category")
def v6(spark, sf_dir):
    return rounded(evaluation.measures(judged(spark, sf_dir), ["category"]))


@query("v6_failures", f"WITH {SQL_JUDGED} SELECT query_id, category FROM j WHERE first_rank = 0")
def v6_failures(spark, sf_dir):
    return evaluation.failures(judged(spark, sf_dir)).select("query_id", "category")


@query(
    "v7_compare_modes",
    f"""WITH {SQL_RERANK}, g AS (SELECT item_id AS query_id, substr(text, 1, 40) AS kw FROM benchmark), m AS (SELECT 'reranked' AS mode, query_id, chunk_id, final_rank AS rank FROM o UNION ALL SELECT 'bm25' AS mode, query_id, chunk_id, rank FROM bm UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM ve UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM rr),
             r AS (SELECT m.mode, m.query_id, min(rank) AS f FROM m JOIN g ON g.query_id = m.query_id JOIN documents d ON d.doc_id = m.chunk_id WHERE rank <= 5 AND contains(lower(d.text), lower(kw)) GROUP BY 1, 2),
             j AS (SELECT modes.mode, g.query_id, coalesce(r.f, 0) AS first_rank FROM g CROSS JOIN (VALUES ('bm25'), ('vector'), ('hybrid'), ('reranked')) AS modes(mode) LEFT JOIN r ON r.mode = modes.mode AND r.query_id = g.query_id)
        SELECT mode, {_MEASURES} FROM j GROUP BY mode""",
)
def v7(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    words, near = bm25.small(words_hits(spark, sf_dir)), bm25.small(vector_hits(spark, sf_dir))
    both = bm25.small(fusion.reciprocal_rank_fusion(words, near))
    best = reranked(spark, sf_dir, both).withColumn("rank", F.col("final_rank"))
    modes = {"bm25": words, "vector": near, "hybrid": both, "reranked": best}
    first = [hits.filter("rank <= 5").select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank") for mode, hits in modes.items()]
    seen = bm25.small(texts.join(bm25.small(reduce(lambda x, y: x.unionByName(y), first)), "chunk_id"))
    one = lambda mode: evaluation.judge(golden(spark, sf_dir), seen.filter(F.col("mode") == mode)).withColumn("mode", F.lit(mode))
    every = reduce(lambda x, y: x.unionByName(y), [one(mode) for mode in modes])
    return rounded(evaluation.measures(every, ["mode"]))


@query("v8_id_relevance", f"WITH {SQL_BM25} SELECT query_id, chunk_id, chunk_id = query_id OR chunk_id = query_id + 1 AS relevant FROM bm WHERE rank <= 50")
def v8(spark, sf_dir):
    expected = F.array(F.col("query_id"), F.col("query_id") + 1)
    return words_hits(spark, sf_dir).select("query_id", "chunk_id", evaluation.id_relevance("chunk_id", expected).alias("relevant"))


@query("v9_false_positives", f"WITH {SQL_JUDGED} SELECT query_id, false_positives FROM j")
def v9(spark, sf_dir):
    return judged(spark, sf_dir).select("query_id", "false_positives")


# ---- query log ------------------------------------------------------------------------------------------------------


@query(
    "l1_s6_log_records",
    f"""WITH {SQL_BM25}, h AS (SELECT * FROM bm WHERE rank <= 5)
        SELECT b.item_id AS query_id, '2024-01-02T03:04:05.000000+00:00' AS timestamp, 'INFO' AS level, md5(concat('Tool search called with query: ', b.text)) AS message, 'max_results=5' AS params, 'tool_call' AS event, CAST(count(h.chunk_id) AS INTEGER) AS results_count, coalesce(array_to_string(list(CAST(h.chunk_id AS VARCHAR) ORDER BY h.rank) FILTER (WHERE h.chunk_id IS NOT NULL), ','), '') AS chunk_ids
        FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id GROUP BY b.item_id, b.text""",
)
def l1(spark, sf_dir):
    hits = words_hits(spark, sf_dir).filter("rank <= 5").select("query_id", "rank", F.col("chunk_id").alias("id"), F.concat(F.lit("Title "), "chunk_id").alias("title"), "score")
    calls = asked(spark, sf_dir).drop("vector").withColumn("max_results", F.lit(5))
    made, path = querylog.log_records(calls, hits, at=F.lit(AT).cast("timestamp"), params=["max_results"]), storage.work_folder(spark)
    storage.write_json_log(made, path)
    params = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return spark.read.schema(made.schema).json(path).select("query_id", "timestamp", "level", F.md5("message").alias("message"), params.alias("params"), "event", "results_count", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("l2_flag_repeats", "SELECT conv_id AS session, turn AS ts, regexp_extract(text, '^(\\S*)', 1) AS query, row_number() OVER (PARTITION BY conv_id, regexp_extract(text, '^(\\S*)', 1) ORDER BY turn) > 1 AS repeated FROM conversations WHERE role = 'user'")
def l2(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return querylog.flag_repeats(said.select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), F.regexp_extract("text", r"^(\S*)", 1).alias("query")))


@query("l2_hot_text", "WITH s AS (SELECT conv_id % 3 AS session, turn AS ts, conv_id, CASE WHEN turn % 2 = 0 THEN 'same' ELSE text END AS query FROM conversations) SELECT session, ts, conv_id, md5(query) AS query, row_number() OVER (PARTITION BY session, query ORDER BY ts, conv_id) > 1 AS repeated FROM s")
def l2_hot(spark, sf_dir):
    """Three sessions, and one text in about half of all rows."""
    said = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("session"), F.col("turn").alias("ts"), "conv_id", F.when(F.col("turn") % 2 == 0, "same").otherwise(F.col("text")).alias("query"))
    return querylog.flag_repeats(said, key=["conv_id"]).withColumn("query", F.md5("query"))


# ---- workloads ------------------------------------------------------------------------------------------------------


@query("w1_pages_to_markdown")
def w1(spark, sf_dir):
    return workflows.pages_to_markdown(read(spark, sf_dir, "pages"), "snapshot", "5.2", F.lit(AT).cast("timestamp"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = w1(spark, sf_dir).filter("error IS NULL")
    return made.select(F.col("rel_path").alias("source_path"), "content", F.lit("1.0").alias("default_version"), F.lit("Guide").alias("default_category"), F.col("url").alias("seq"))


@query("w2_i1_i10_ingest")
def w2(spark, sf_dir):
    made = workflows.ingest(page_files(spark, sf_dir), F.lit(AT).cast("timestamp"), workflows.default_encoder(), low=16)
    return made["chunks"].select("id", "section_id", "document_id", "section_title", "overlap_index", "token_count", "word_count")


@query("w3_r9_r11_answers")
def w3(spark, sf_dir):
    made, path = workflows.ingest(page_files(spark, sf_dir), F.lit(AT).cast("timestamp"), workflows.default_encoder(), low=16), storage.work_folder(spark)
    storage.write_store(made, path)
    tables = storage.read_store(spark, path)
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rerank.api_rows(workflows.answers(tables, queries, workflows.default_encoder(), low=16, threshold=0.3))
