"""The queries of this subpackage for __spark_entry__.py, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import entropy_mix, histogram_shards, packed_ids, piece_codec, quality_bayes, rule_ledger, simhash, spotsigs, substrings, toxicity_chain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def over(report: Callable, *tables: str, **files: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(*(table(spark, sf_dir, t) for t in ("documents", *tables)), **{k: tokenizer(v) for k, v in files.items()})

    return query


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_bayes": over(quality_bayes.quality_report, "labels"),
        "op2_rule_ledger": over(rule_ledger.rules_report),
        "op3_piece_codec": over(piece_codec.codec_report, model="piece_bpe_32k.model"),
        "op4_entropy_mix": over(entropy_mix.mix_report),
        "op5_toxicity_chain": over(toxicity_chain.toxicity_report, "labels"),
        "op6_simhash": over(simhash.fingerprint_report),
        "op7_substrings": over(substrings.removed_report),
        "op8_histogram_shards": over(histogram_shards.shard_report),
        "op9_spotsigs": over(spotsigs.spots_report),
        "op10_packed_ids": over(packed_ids.packed_report, tokenizer="word_bpe_49k.json"),
        "pipeline": pipeline,
    }


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_upper, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations
  FROM d LEFT JOIN cov USING (r)),
f AS (
  SELECT *, CAST((n_words < 20)::INT * 1 + (100 * n_repeat_words > 30 * n_words)::INT * 2 + (5 * n_symbols > n_words)::INT * 4
              + (100 * n_dup_lines > 30 * n_lines)::INT * 8 + (word_chars < 2 * n_words)::INT * 16 + (word_chars > 20 * n_words)::INT * 32
              + (2 * n_upper > word_chars)::INT * 64 + (2 * n_exclamations > n_words)::INT * 128 AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM win) WHERE n > 1),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
mark AS (
  SELECT word.r, p, x, max(rep.i) OVER (PARTITION BY word.r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN rep ON rep.r = word.r AND rep.i = p),
agg AS (SELECT r, count_if(gone) AS n, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM mark GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_rule_ledger": OP2_SQL, "op7_substrings": OP7_SQL}
