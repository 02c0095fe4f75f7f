"""The registered queries of the operators: thin wrappers that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.ann import nearest
from inkwell.llm.bpe import bpe_digests
from inkwell.llm.common import id_crc, read, scratch_path
from inkwell.llm.exact_dedup import exact_groups
from inkwell.llm.html_text import extract_text
from inkwell.llm.licenses import scan_licenses
from inkwell.llm.mixing import fair_queue
from inkwell.llm.near_dup import near_duplicates
from inkwell.llm.quality import fit_quality, score_quality
from inkwell.llm.token_store import read_tokens, write_tokens
from inkwell.llm.toxicity import fit_toxicity, score_toxicity
from inkwell.llm.url_filter import judge_urls
from inkwell.llm.vector_codes import code_report
from inkwell.llm.whitening import whitened


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, crc = read(spark, sf_dir, "documents"), id_crc(F.col("doc_id"))
    model = fit_quality(docs, read(spark, sf_dir, "labels"), train=crc % 5 != 0)
    return score_quality(docs, model).select("doc_id", (crc % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, crc = read(spark, sf_dir, "documents"), id_crc(F.col("doc_id"))
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), train=crc % 4 != 2)
    return score_toxicity(docs, model).select("doc_id", (crc % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    files = write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    back = read_tokens(files, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = fair_queue(read(spark, sf_dir, "documents"), WEIGHTS, share=1.0, repeats=3)
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_copies")).alias("taken"))


def op9_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(read(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"), components=32)


#: Actions with a host and the beginning of a path.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_license_scan": op5_license_scan,
    "op6_bpe": op6_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_source_mix": op8_source_mix,
    "op9_one_bit_ann": op9_one_bit_ann,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
    "pipeline": pipeline,
}


def _rounds(rounds: int = 4) -> str:
    """SQL of op11: entries e0, then for each round the parts' nearest entries (code, distance) and the entries moved."""
    near = """a{0} AS (SELECT vec_id, part, min(CAST(p.norm + e.norm - 2 * list_inner_product(p.v, e.v) AS BIGINT) * 256 + entry) AS best FROM p JOIN e{0} AS e USING (part) GROUP BY vec_id, part)"""
    move = """
             m{1} AS (SELECT part, best % 256 AS entry, place, floor(sum(v[place]) / count(*)) AS x FROM a{0} JOIN p USING (vec_id, part), range(1, len(v) + 1) AS r(place) GROUP BY part, entry, place),
             n{1} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM m{1} GROUP BY part, entry),
             e{1} AS (SELECT part, entry, v, list_inner_product(v, v) AS norm FROM (SELECT part, entry, coalesce(n.v, e.v) AS v FROM e{0} AS e LEFT JOIN n{1} AS n USING (part, entry)))"""
    return ",".join(f"{near.format(i)},{move.format(i, i + 1)},\n             " for i in range(rounds)).replace(",\n             ,", ",\n             ") + near.format(rounds)


ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS s FROM documents),
             g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY s)
        SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.s AS text_sha256
        FROM d JOIN g ON d.s = g.s""",
    "op11_vector_codes": f"""
        WITH k AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT vec_id, part, list_slice(v, CAST(part * len(v) / 4 AS BIGINT) + 1, CAST((part + 1) * len(v) / 4 AS BIGINT)) AS v FROM k, range(4) AS r(part)),
             p AS (SELECT *, list_inner_product(v, v) AS norm FROM s),
             e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v, norm FROM p QUALIFY entry < 256),
             {_rounds()},
             c AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
             l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN k USING (vec_id) GROUP BY label),
             b AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e4)
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, b""",
    "op13_url_filter": r"""
        WITH u AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             l AS (SELECT DISTINCT regexp_replace(url, '#.*', '') AS a, regexp_replace(unnest(regexp_extract_all(html, '<link rel="canonical" href="(https?://[^"]+)"', 1)), '#.*', '') AS b FROM pages),
             e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
             h AS (SELECT DISTINCT a, translate(regexp_extract(a, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM e),
             r AS (SELECT action, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
                   FROM (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')) AS v(action, rule)),
             best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
                      FROM (SELECT host, path FROM u UNION SELECT host, path FROM h) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
             w AS (SELECT a, rule FROM h JOIN best USING (host, path) WHERE action = 'block'),
             t AS (WITH RECURSIVE t AS (SELECT a, rule FROM w UNION SELECT e.b, t.rule FROM t JOIN e ON t.a = e.a) SELECT a, min(rule) AS alias_rule FROM t GROUP BY a)
        SELECT page_id, u.host, u.path, best.rule, coalesce(best.action, CASE WHEN t.alias_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict,
               CASE WHEN best.rule IS NULL THEN t.alias_rule END AS alias_rule
        FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path LEFT JOIN t ON regexp_replace(u.url, '#.*', '') = t.a""",
    "op9_one_bit_ann": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             p AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id != v.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_source_mix": """
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                          md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS shuffle FROM documents),
             g AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
             w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM g),
             f AS (SELECT *, s * 3 / weight AS fills, sum(s) OVER () AS total, sum(weight) OVER () AS every FROM w),
             c AS (SELECT *, (total - coalesce(sum(s * 3) OVER before, 0)) / (every - coalesce(sum(weight) OVER before, 0)) AS level FROM f
                   WINDOW before AS (ORDER BY fills, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             t AS (SELECT source, no, CAST(s AS BIGINT) AS source_size, least(coalesce(weight * (SELECT level FROM c WHERE level <= fills ORDER BY fills, no LIMIT 1), s * 3), s * 3) AS target FROM c),
             q AS (SELECT doc_id, size, no, source_size, target, sum(size) OVER (PARTITION BY no ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             e AS (SELECT *, row_number() OVER () AS r, CASE WHEN size > 0 AND target > 0 THEN least(3, greatest(0, floor((target - upto) / source_size) + 1)) ELSE 0 END AS early FROM q),
             l AS (SELECT r, size, no, doc_id, upto / target + k * source_size / target AS finish FROM e, (VALUES (0), (1), (2)) AS rounds(k)
                   WHERE size > 0 AND target > 0 AND k >= early),
             o AS (SELECT r, sum(size) OVER (ORDER BY finish, no, doc_id, size ROWS UNBOUNDED PRECEDING) AS queue FROM l),
             n AS (SELECT r, count(*) AS late FROM o WHERE queue <= (SELECT sum(size) - sum(size * early) FROM e) GROUP BY r)
        SELECT doc_id, size, source_size, target, CAST(size * (early + coalesce(late, 0)) AS BIGINT) AS taken FROM e LEFT JOIN n USING (r)""",
}
