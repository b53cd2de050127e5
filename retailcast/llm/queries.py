"""The corpus operators as queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.llm.divergence import source_divergence
from retailcast.llm.exact_dedup import exact_dedup
from retailcast.llm.jaccard_join import near_duplicates
from retailcast.llm.licences import licence_report
from retailcast.llm.main_text import main_texts
from retailcast.llm.merkle import merkle_manifest
from retailcast.llm.mixing import mix
from retailcast.llm.packing import pack
from retailcast.llm.passages import repeated_passages
from retailcast.llm.pii import pii_report
from retailcast.llm.quality import quality_scores
from retailcast.llm.revisits import resolve_revisits
from retailcast.llm.topk import top_rows

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(_table(spark, folder, "documents"))


def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licence_report(_table(spark, folder, "documents"))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii_report(_table(spark, folder, "documents"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def archive_records(pages: DataFrame) -> DataFrame:
    """A full response for every page, and two revisits: one after it, whose validators agree, differ
    or are absent in turn, and one at an earlier time, for which another capture of the same page may
    stand, or none. Half of the agreeing tags are weak, and every third URL names its port."""
    time = (F.col("page_id") * 7919) % 1_000_003
    tag, digest = F.md5("html"), F.sha2("html", 256)
    none = F.lit(None).cast("string")
    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), time.cast("string"), F.lit("etag"), tag, F.lit("server"), F.lit("origin"))

    def fresh(at):
        return F.create_map(F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id") % 100), F.lit("Date"), at.cast("string"), F.lit("Server"), F.lit("cache"))

    ported = F.regexp_replace(F.regexp_replace("url", "^(https://[^/?#:]+)", "$1:443"), "^(http://[^/?#:]+)", "$1:80")

    def record(number, kind, at, etag, body, headers, url=F.col("url")):
        return pages.select(
            (F.col("page_id") * 4 + number).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at.alias("time"), etag.alias("etag"),
            none.alias("last_modified"), body.alias("digest"), headers.alias("headers"),
        )

    later, sooner, turn = time + 1 + F.col("page_id") % 1000, time - 500, F.col("page_id") % 4
    weak = F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    etag = F.when(turn == 0, weak).when(turn == 1, F.lit("stale"))
    responses = record(0, "response", time, tag, digest, stored)
    revisits = record(1, "revisit", later, etag, F.when(turn == 2, digest), fresh(later), F.when(F.col("page_id") % 3 == 0, ported).otherwise(F.col("url")))
    return responses.unionByName(revisits).unionByName(record(2, "revisit", sooner, tag, none, fresh(sooner)))


def op6_revisits(spark: SparkSession, folder: str) -> DataFrame:
    resolved = resolve_revisits(archive_records(_table(spark, folder, "pages")))
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return resolved.withColumn("headers", F.array_join(F.array_sort(pairs), ";"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(_table(spark, folder, "documents"))


def op10_top_rows(spark: SparkSession, folder: str) -> DataFrame:
    return top_rows(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(_table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle_manifest(docs, presented={"text": text})


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(_table(spark, folder, "pages"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

# Response and revisits as in archive_records; the canonical form of a URL as in revisits.canonical_url.
OP6_SQL = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', '', 'g'), '^(?i:https?)://', '', 'g') AS b,
         CASE WHEN trim(url) ILIKE 'https://%' THEN ':443$' ELSE ':80$' END AS port FROM pages
), parts AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^(www|m)\.', '', 'g'), port, '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '(\.html)?/*$', '', 'g') AS path,
         array_to_string(list_sort(string_split(regexp_replace(regexp_replace(
           regexp_extract(b, '\?(.*)$', 1), '(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?', '', 'g'), '^&', '', 'g'), '&')), '&') AS query
  FROM bare
), captured AS (
  SELECT page_id, (page_id * 7919) % 1000003 AS time, md5(html) AS tag, sha256(html) AS digest,
         host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical
  FROM parts
), revisit AS (
  SELECT page_id * 4 + 1 AS revisit_id, canonical, time + 1 + page_id % 1000 AS time, page_id % 100 AS age,
         CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 8 = 0 THEN 'W/' ELSE '' END || tag WHEN 1 THEN 'stale' END AS etag, CASE page_id % 4 WHEN 2 THEN digest END AS digest
  FROM captured
  UNION ALL
  SELECT page_id * 4 + 2, canonical, time - 500, page_id % 100, tag, NULL FROM captured
), response AS (
  SELECT page_id * 4 AS response_id, canonical, time, tag, digest FROM captured
  QUALIFY row_number() OVER (PARTITION BY canonical, time ORDER BY page_id DESC) = 1
), met AS (
  SELECT v.*, r.response_id, r.time AS response_time, r.tag AS r_tag,
         CASE WHEN v.digest IS NOT NULL AND r.response_id IS NOT NULL THEN 'digest'
              WHEN v.etag IS NOT NULL AND r.response_id IS NOT NULL THEN 'etag' END AS validator,
         CASE WHEN v.digest IS NOT NULL THEN v.digest = r.digest ELSE regexp_replace(v.etag, '^W/', '') = r.tag END AS agrees
  FROM revisit v ASOF LEFT JOIN response r ON v.canonical = r.canonical AND v.time > r.time
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN validator IS NULL THEN 'unchecked' WHEN agrees THEN 'resolved' ELSE 'mismatch' END AS status FROM met
)
SELECT revisit_id, canonical, response_id, response_time, status, validator,
       'Cache-Control=max-age=' || age || ';Date=' || time ||
       CASE WHEN status = 'resolved' THEN ';content-type=text/html;etag=' || r_tag || ';server=origin' ELSE ';Server=cache' END AS headers
FROM judged
"""

OP10_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), sized AS (
  SELECT l.lang, CAST(count(k.term) AS HUGEINT) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         1 + 1000000000 * (k.n + 5) // (s.total + 5 * s.v) AS q, s.v
  FROM g JOIN kept k USING (lang) JOIN sized s USING (lang) LEFT JOIN c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, q, 1 + 1000000000 * (n + 5) // (total + 5 * v) AS p FROM full_counts
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM every
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""


def _framed(*values: str) -> str:
    """The digest of values, each with the number of its UTF-8 bytes; ``-`` for null."""
    parts = [f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    bit = "CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda s, k: {bit})"
    codes = f"[CAST(ord(c) AS BIGINT) FOR c IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {byte}), 4294967295)"


def _merkle_sql(levels: int) -> str:
    """Trees of at most 8 ** ``levels`` leaves, level by level: h0 holds leaves, and a tree that has come
    to one node keeps it. The groups' subroots are one more such tree."""

    def tree(name: str, base: str) -> list[str]:
        parts = [f"{name}0 AS ({base})"]
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (SELECT g, j AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
                    count(*) OVER (PARTITION BY g) AS n FROM (SELECT *, i // 8 AS j FROM {name}{k}) GROUP BY g, j, n)"""
            )
            # The run's other digests on either side of a node, none in a finished tree.
            for side, test in (("b", "<"), ("a", ">")):
                parts.append(
                    f"""{name}{side}{k} AS (SELECT x.g, x.i, string_agg(y.h, '' ORDER BY y.i) AS h FROM {name}{k} x
                        JOIN {name}{k} y ON x.g = y.g AND x.i // 8 = y.i // 8 AND y.i {test} x.i GROUP BY x.g, x.i)"""
                )
        return parts

    text = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    leaf, shown = _framed("doc_id", "source", "lang", "n_chars", "text"), _framed("doc_id", "source", "lang", "n_chars", "shown")
    parts = [
        f"d AS (SELECT *, coalesce('+' || lang, '') AS g, {_crc32_sql('CAST(doc_id AS VARCHAR)')} AS crc FROM documents)",
        f"l AS (SELECT *, {leaf} AS leaf, {shown} AS shown_leaf FROM (SELECT *, {text} AS shown FROM d))",
        "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM l)",
        *tree("h", "SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p"),
        *tree("t", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM h{levels}"),
    ]
    state = "SELECT p.doc_id, p.g, p.leaf, p.shown_leaf AS cur, '' AS proof, p.i, s.h AS subroot, s.i AS top FROM p JOIN t0 s ON s.name = p.g"
    parts.append(f"f0 AS ({state})")
    number = 0
    for name, group, place in (("h", "f.g", "i"), ("t", "''", "top")):
        for k in range(levels):
            at = f"f.{place} // {8**k}"
            parts.append(
                f"""f{number + 1} AS (SELECT f.* REPLACE (
                    CASE WHEN n.n = 1 THEN cur ELSE sha256(coalesce(b.h, '') || cur || coalesce(a.h, '')) END AS cur,
                    proof || coalesce(b.h, '') || coalesce(a.h, '') AS proof)
                    FROM f{number} f JOIN {name}{k} n ON n.g = {group} AND n.i = {at}
                    LEFT JOIN {name}b{k} b ON b.g = {group} AND b.i = {at} LEFT JOIN {name}a{k} a ON a.g = {group} AND a.i = {at})"""
            )
            number += 1
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
        FROM f{number}, t{levels} r"""


# Seven levels: up to two million documents in a language.
OP12_SQL = _merkle_sql(7)


def queries() -> dict[str, Query]:
    own = (
        op1_exact_dedup,
        op2_licence_scan,
        op3_personal_data,
        op4_source_mix,
        op5_quality_rules,
        op6_revisits,
        op7_jaccard_join,
        op8_packing,
        op9_repeated_passages,
        op10_top_rows,
        op11_source_divergence,
        op12_merkle_manifest,
        op13_main_text,
    )
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_revisits": OP6_SQL, "op10_top_rows": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
