"""The corpus operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counting, ogg, packing, quality, rules, secrets, simhash, substrings, toxicity


def vocabulary(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_intervals(documents(spark, sf_dir)).drop("intervals")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans")
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_column(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_simhash, op2_bpe, op3_token_counts, op4_substrings, op5_secrets, op6_media, op7_quality, op8_rules, op9_packing, op10_toxicity,
    )
    return {f.__name__: f for f in every}


#: Windows by their words: exact, and fit for small tables alone, as every window is a string of its own.
_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, w, unnest(range(1, len(w) - {substrings.WIDTH} + 2)) AS i FROM d),
named AS (SELECT r, i, array_to_string(w[i : i + {substrings.WIDTH} - 1], ' ') AS h FROM windows),
repeated AS (SELECT h FROM named GROUP BY h HAVING count(*) > 1),
gone AS (SELECT r, i + k AS p FROM (SELECT r, i FROM named SEMI JOIN repeated USING (h)) CROSS JOIN range({substrings.WIDTH}) t(k) GROUP BY ALL),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": _OP4}
