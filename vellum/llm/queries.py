"""The registered queries of the operators (``opN_<name>``) over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import (
    decontam,
    fingerprints,
    hard_negatives,
    lexical_search,
    line_dedup,
    packing,
    partenum,
    pii_surrogates,
    quality,
    secret_scan,
    simple8b,
    suffix_dedup,
    token_counts,
)
from vellum.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def twin(sql: str):
    """Register a query with its DuckDB twin."""
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLE[fn.__name__] = sql
        return query(fn)
    return register


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(read_table(spark, sf_dir, "documents"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlap(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = partenum.similar(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fixed key, so that results can be compared; a user passes a secret one
    return pii_surrogates.surrogates(read_table(spark, sf_dir, "documents"), key="op9 results are compared")


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(read_table(spark, sf_dir, "documents"))


@twin("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
             CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score
      FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
           ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = (rf"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term")


@twin(f"""
WITH w AS (SELECT doc_id, {_TERMS} FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * t.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM p, t GROUP BY term, t.docs),
c AS (SELECT p.doc_id, p.term, f.weight * ((1000000000 * tf)
             // (1000 * tf + 8 * (100 - 90 + ((90 * n.n * t.docs) // t.total)))) AS gain
      FROM p JOIN f USING (term) JOIN n USING (doc_id), t),
s AS (SELECT q.item_id, c.doc_id, CAST(sum(c.gain) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@twin(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.*, coalesce(k.doc_id > f.first, FALSE) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read_table(spark, sf_dir, "documents"))
