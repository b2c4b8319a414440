"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, line_dedup, lm_score, longest_match, merkle, ngram_join, packing, quality_classifier, quality_rules, token_files, tokens, vector_codes, warc

WORD_TOKENIZER, BYTE_RANKS, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_capture_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_histories(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp", "capture")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, _read(spark, sf_dir, "labels")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), P.path(WORD_TOKENIZER))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bpe_digests(_read(spark, sf_dir, "documents"), P.path(BYTE_RANKS), P.PATTERN)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), 3, (90, 100))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_match.token_counts(_read(spark, sf_dir, "documents"), P.path(WORD_TOKENIZER))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.neighbour_fingerprints(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle_digests(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_errors(_read(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_read(spark, sf_dir, "documents"), P.path(BYTE_TOKENIZER))


QUERIES = {f.__name__: f for f in (
    op1_capture_histories, op2_quality_rules, op3_quality_classifier, op4_line_dedup, op5_packing, op6_byte_bpe,
    op7_ngram_jaccard, op8_lm_scoring, op9_token_counts, op10_merkle_fingerprints, op11_fill_in_middle, op12_vector_codes, op13_token_files,
)}



def _codebook_rounds(rounds: int = 4) -> str:
    """Assignments and codebooks of every round, each from those before."""
    search = """a{i} AS MATERIALIZED (SELECT r, j, min(d) AS d, min_by(i, d*256 + i) AS i FROM (SELECT r, p.j, c.i, vv - 2*list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v) AS d FROM p JOIN c{i} c ON p.j = c.j) GROUP BY r, j)"""
    update = """m{i} AS (SELECT j, i, list(x ORDER BY pos) AS v FROM (SELECT p.j, a.i, pos, floor(sum(p.v[pos])/count(*)) AS x FROM a{i} a JOIN p ON p.r = a.r AND p.j = a.j, (SELECT unnest(range(1, (SELECT max(w) + 1 FROM k))) AS pos) GROUP BY ALL) GROUP BY j, i),
        c{n} AS MATERIALIZED (SELECT c.j, c.i, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j AND m.i = c.i)"""
    return ",\n        ".join(search.format(i=i) + (",\n        " + update.format(i=i, n=i + 1) if i < rounds else "") for i in range(rounds + 1))


ORACLES = {
    "op1_capture_histories": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1),
             r AS (SELECT page_id AS id, regexp_replace(coalesce(url, ''), '^.*?://', '') AS rest FROM pages),
             s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_extract(rest, '^[^/]*'), '[^@]*$')), ':80$', ''), ':443$', ''), '^www[.]', '') AS host,
                          regexp_extract(rest, '/.*$', 0, 's') AS path FROM r),
             u AS (SELECT id, CASE WHEN host = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path END AS urlkey,
                          strftime(TIMESTAMP '2020-01-01' + to_seconds(coalesce(id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM s)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to,
               urlkey, stamp, row_number() OVER (PARTITION BY urlkey ORDER BY stamp, page_id) AS capture
        FROM p JOIN u ON page_id = id LEFT JOIN f ON payload_digest = d
    """,
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
             g AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS u, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS v, CAST('0x' || h[17:24] AS BIGINT) % 100 AS cut, CAST('0x' || h[25:32] AS BIGINT) % 100 AS way FROM d),
             f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR cut >= 90 THEN 'plain' WHEN way < 20 THEN 'spm' ELSE 'psm' END AS form, least(u, v) AS a, greatest(u, v) AS b FROM g),
             p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op12_vector_codes": f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, len(embedding)//4 AS w, list_transform(embedding, lambda x: floor(1024*CAST(x AS DOUBLE))) AS e
                  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM (SELECT r, j, e[j*w + 1:j*w + w] AS v FROM k, (SELECT unnest(range(4)) AS j))),
        c0 AS MATERIALIZED (SELECT j, r - 1 AS i, v FROM p WHERE r <= 256),
        {_codebook_rounds()},
        t AS (SELECT r, string_agg(printf('%02x', i), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r),
        h AS (SELECT sha256(string_agg(s, ',' ORDER BY j, i)) AS codebooks_sha256 FROM (SELECT j, i, list_aggregate(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS s FROM c4))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN t USING (r), h
    """,
}
