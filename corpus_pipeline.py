"""The corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of
``documents``, and all give few files. ``run`` writes each stage's result to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import packing, rules, secrets, simhash, substrings
from keyloom.llm.queries import vocabulary
from keyloom.session import few_files, materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _stage(f):
    """Stages know doc_id, text and n_chars; other columns go through them under names that cannot clash with theirs.

    Of columns whose names differ only in case, the exact one is known, or else the first.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [f"other_{i}" for i in range(len(names))]
        for known in ("doc_id", "text", "n_chars"):
            same = [i for i, n in enumerate(names) if n == known] or [i for i, n in enumerate(names) if n.lower() == known]
            if same:
                plain[same[0]] = known
        return few_files(f(spark, docs.toDF(*plain), sf_dir).toDF(*names))

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no risk-controlled rule rejects.

    Null, empty and short texts go. Very long ones are counted whole. Rows with a null id are judged and not learnt from; repeated
    rows are judged alike, and all of them stay or go. An empty table stays empty.
    """
    return rules.keep_good(docs, _labels(spark, sf_dir))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last.

    Groups are linked by five-word shingles at a similarity of 0.8 or more. Null, empty and blank texts are one group. Of rows with
    an equal id and text one stays, also if they differ in another column. An empty table stays empty.
    """
    return simhash.keep_one(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere; a document of which nothing is left goes.

    Null, empty and blank texts have nothing to lose: they stay, a null text as an empty one. Repeated rows of 35 words or more
    repeat each other, and go. Texts of any length are cut whole; a null id is an id like any other. An empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc_id"), "text")
    cut = substrings.cut_texts(carried).where("n_removed < n_words or n_words = 0")
    back = cut.select(*[F.col("text") if c == "text" else F.col(f"doc_id.`{c}`") for c in docs.columns])
    return _recounted(back)


@_stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret.

    Every row stays, nulls as nulls; overlapping secrets become one mark. Repeated rows are marked alike, as are tokens of equal
    evidence. Long texts are scanned whole. An empty table stays empty.
    """
    return _recounted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences.

    Null and empty texts are an end token alone. Repeated rows, and rows with a null id, are packed each by itself; long texts are
    cut at full windows. An empty table gives no pieces.
    """
    return few_files(packing.pack_documents(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_scans),
    ("packing", pack),
]
#: Hashes, tests of randomness and tokenizers are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
