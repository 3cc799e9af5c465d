"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, fingerprints, languages, neardup, packing, pii, quality, shards, substring, tokenfile
from emberlog.llm.common import documents

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_BPE)
    return bpe.digests(bpe.encode(documents(spark, sf_dir), path), path)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(documents(spark, sf_dir))


def op3_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(documents(spark, sf_dir))


def op4_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(documents(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=2)
    return tokenfile.read(spark, manifest, tokenfile.summary, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", *quality.STATISTICS, "base_failed", "kept", "distance")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = languages.fit(docs.where(~held_out))
    return languages.identify(docs, model, extra=[held_out.alias("held_out")])


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slot_map = shards.place(documents(spark, sf_dir), shards=24)
    shards.store(spark, [shards.SlotMap.even(24), slot_map])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_bpe, op2_substring, op3_cws, op4_planes, op5_quality, op6_pii, op7_languages, op8_shards, op9_neardup, op10_packing]
    return {f.__name__: f for f in own}


#: Windows of 20 words by their smallest place; words in a window that is not there for the first time go.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(list_slice(w, s, s + 19), ' ') ORDER BY doc_id, s) AS nth FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS pos FROM ranked WHERE nth > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d),
marked AS (SELECT words.doc_id, words.pos, words.word, gone.pos IS NOT NULL AS removed FROM words LEFT JOIN gone USING (doc_id, pos)),
left_over AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

#: Distinct shingles, links by counted intersections, and the closure of the links.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Exact set problems; the other methods' estimates, encodings and plans have no SQL form and are tested against brute force."""
    return {"op2_substring": OP2_SQL, "op9_neardup": OP9_SQL}
