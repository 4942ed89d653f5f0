"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapengine.llm import (
    collocations,
    fingerprints,
    hard_negatives,
    line_dedup,
    lm_score,
    mixing,
    packing,
    pii,
    quality,
    simhash,
    tokens,
    topk,
    url_filter,
)
from mapengine.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIMIT = 512
# Stands for the secret of a deployment, which would come from its own store.
KEY = "registered query"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    print_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", print_, "component_id")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, RANKS, length=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, KEY).select("doc_id", "n_private", "private", "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        F.base64("digest").alias("fingerprint"), F.base64("edited_digest").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.thin_hosts(pages))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "text", tokens.token_counts(F.col("text"), VOCABULARY, LIMIT).alias("t"))
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("t.n_tokens").alias("n_tokens"), (F.col("t.n_tokens") > LIMIT).alias("over_limit"),
        F.col("t.within").alias("chars_within_limit"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, id_ = F.col("label").cast("long"), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0, positives_each=5, negatives_each=5, low=80, high=100)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=5, min_count=100, first=2000)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_mixing": op2_mixing,
        "op3_simhash": op3_simhash,
        "op4_lm_score": op4_lm_score,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_pii": op7_pii,
        "op8_fingerprints": op8_fingerprints,
        "op9_url_filter": op9_url_filter,
        "op10_token_counts": op10_token_counts,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_collocations": op12_collocations,
        "op13_exact_topk": op13_exact_topk,
        "pipeline": pipeline,
    }


_LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS last FROM keyed
    WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS dropped
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_URL_FILTER = rf"""
WITH parts AS (
    SELECT page_id, html,
           CASE WHEN instr(coalesce(url, ''), '://') > 0
                THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), hosts AS (
    SELECT page_id, html,
           translate(regexp_extract(rest, '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
    END AS rule
    FROM hosts
), linked AS (
    SELECT host, sum(len(regexp_extract_all(coalesce(html, ''), '<a[ \t\r\n>]'))) AS links,
           sum(len(regexp_extract_all(coalesce(html, ''), '<p[ \t\r\n>]'))) AS paragraphs
    FROM hosts WHERE host <> '' GROUP BY host
), ranked AS (
    SELECT host, least(100 * links // (paragraphs + 1), {url_filter.MOST}) AS ratio FROM linked WHERE links > 0
), thin AS (
    SELECT host FROM ranked WHERE ratio >= (SELECT quantile_disc(ratio, {1 - url_filter.THIN}) FROM ranked)
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN (SELECT host FROM thin) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


_USABLE = """
WITH usable AS (
    SELECT vec_id, min(struct_pack(v := embedding, l := label)) AS row
    FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 AND {relabelled} THEN (label::BIGINT + 1) % 10 ELSE label END AS label
          FROM embeddings)
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND (label IS NOT NULL OR NOT {relabelled})
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id
), vectors AS (
    SELECT vec_id AS id, row.l AS label, list_transform(row.v, lambda x: floor(256 * x::DOUBLE)) AS v FROM usable
)
"""

_HARD_NEGATIVES = _USABLE.format(relabelled="true") + """
, scored AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS mate, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE mate
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id)::INTEGER AS rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.mate
 AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

_TOP_K = _USABLE.format(relabelled="false") + """
SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
       row_number() OVER (PARTITION BY q.id ORDER BY score DESC, c.id)::INTEGER AS rank
FROM vectors q JOIN vectors c ON q.id % 50 = 0 AND q.id <> c.id
QUALIFY rank <= 5
"""

_COLLOCATIONS = r"""
WITH pieces AS (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), sizes AS (
    SELECT lang, sum(len(words))::HUGEINT AS n FROM worded GROUP BY lang
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM worded
), phrases AS (
    SELECT lang, list_slice(words, pos, pos + size - 1) AS phrase
    FROM starts, (SELECT unnest(range(1, 6)) AS size) WHERE pos + size - 1 <= len(words)
), counts AS (
    SELECT lang, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY lang, phrase HAVING count(*) >= 100
), cuts AS (
    SELECT lang, phrase, f AS a, unnest(range(1, len(phrase))) AS k FROM counts WHERE len(phrase) > 1
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, s.n, (1000 * c.a * s.n) // (x.f * y.f) AS score
    FROM cuts c JOIN sizes s ON s.lang = c.lang
    JOIN counts x ON x.lang = c.lang AND x.phrase = list_slice(c.phrase, 1, c.k)
    JOIN counts y ON y.lang = c.lang AND y.phrase = list_slice(c.phrase, c.k + 1, len(c.phrase))
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), held AS (
    SELECT DISTINCT c.lang, c.phrase FROM counts c JOIN counts d
      ON d.lang = c.lang AND len(d.phrase) > len(c.phrase) AND 100 * d.f >= 100 * c.f
     AND (list_slice(d.phrase, 1, len(c.phrase)) = c.phrase OR list_slice(d.phrase, 2, len(c.phrase) + 1) = c.phrase
          OR list_slice(d.phrase, 3, len(c.phrase) + 2) = c.phrase OR list_slice(d.phrase, 4, len(c.phrase) + 3) = c.phrase)
    WHERE len(c.phrase) > 1
), kept AS (
    SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM scored ANTI JOIN held USING (lang, phrase)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express in full. The others are tested by brute force."""
    return {
        "op1_line_dedup": _LINE_DEDUP,
        "op9_url_filter": _URL_FILTER,
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op12_collocations": _COLLOCATIONS,
        "op13_exact_topk": _TOP_K,
    }
