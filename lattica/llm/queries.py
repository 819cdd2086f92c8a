"""The registered queries of this subpackage: thin forms over the operators."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm import (
    ann_forest, decontaminate, fingerprint, hard_negatives, lexical, mixture, quality, secrets, simhash, substring_dedup, suffix_dedup, token_counts, warc)

Build = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_repeats(C.table(spark, folder, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(C.table(spark, folder, "documents"), C.table(spark, folder, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(C.table(spark, folder, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    spec = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    out = token_counts.count_tokens(C.table(spark, folder, "documents"), spec)
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    out = fingerprint.with_next(C.table(spark, folder, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, C.table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(C.table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_components(C.table(spark, folder, "documents"), shingle=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = secrets.scan(C.table(spark, folder, "documents"))
    return out.select("doc_id", "start", F.length("token").alias("length"), F.sha2("token", 256).alias("token_sha256"), "score", "secret")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(C.table(spark, folder, "pages")).drop("intact")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(C.table(spark, folder, "documents"), C.table(spark, folder, "benchmark"), k=20)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(C.table(spark, folder, "embeddings"), label=moved)


def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann_forest.nearest(C.table(spark, folder, "embeddings"), k=5)


QUERIES: dict[str, Build] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixture": op7_mixture,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest": op13_nearest,
}

#: Every 13-word window as text, its first document, and the words of windows that start earlier elsewhere.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
 f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM (SELECT doc_id, i FROM w JOIN f USING (k) WHERE first < doc_id)),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: Every 100-byte string, its first place, and the bytes of strings that start earlier; bytes go through hexadecimal text.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 w AS (SELECT doc_id, i, b[i:i + 99] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w),
 ends AS (SELECT doc_id, i AS p, 1 AS v FROM f WHERE r > 1 UNION ALL SELECT doc_id, i + 100, -1 FROM f WHERE r > 1),
 cover AS (SELECT doc_id, p, sum(sum(v)) OVER (PARTITION BY doc_id ORDER BY p) AS c, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM ends GROUP BY doc_id, p),
 marks AS (SELECT doc_id, p, c, q, coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY p), 0) AS c0 FROM cover),
 runs AS (SELECT doc_id, p AS lo, (SELECT min(m.p) FROM marks m WHERE m.doc_id = marks.doc_id AND m.p > marks.p AND m.c = 0) AS hi FROM marks WHERE c > 0 AND c0 = 0),
 per AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS removed, list({'lo': lo, 'hi': hi} ORDER BY lo) AS rs FROM runs GROUP BY doc_id),
 h AS (SELECT doc_id, hex(b) AS x, octet_length(b) AS size, n, removed, list_concat([{'lo': 1, 'hi': 1}], coalesce(rs, []), [{'lo': octet_length(b) + 1, 'hi': octet_length(b) + 1}]) AS rs FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(size AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
 sha256(unhex(array_to_string(list_transform(range(1, len(rs)), lambda j: substring(x, CAST(2 * rs[j].hi - 1 AS BIGINT), CAST(2 * (rs[j + 1].lo - rs[j].hi) AS BIGINT))), ''))) AS kept_sha256
FROM h"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
 CASE WHEN strlen(body) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN strlen(body) >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""

#: Integer arithmetic on term counts; every weight is floored in doubles.
OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ws)) AS BIGINT) AS total FROM t WHERE len(ws) > 0),
 tf AS (SELECT d, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM t) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, g GROUP BY term),
 q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), g GROUP BY ALL),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""

#: Every anchor against every row, in integers.
OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label,
  CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
 id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""

#: The others count library tokens, hash with XXH64, draw, or train: tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op10_warc": OP10_SQL,
                          "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
