"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are fitted on at most ``SAMPLE`` labelled rows (see :mod:`keyloom.llm.labelled`); their statistics are all that
comes to the driver. Every text is then scored where it is read. Language, source and id are no inputs.

Null texts are empty ones and get the score of a text without words; an empty table gives no rows; texts of any length are read
whole. Repeated rows get equal scores; in the sample a repeated id counts once, with its largest label and least statistics. Of
equally good splits the first feature's lowest cut is taken. Rows with a null id are scored, not learnt from. Columns beside
those read do not matter, also where their names differ from these only in case. Without labelled rows of both kinds every score
is the base rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .gbdt import Forest, fit
from .labelled import SAMPLE, held_out, sample_ids, with_labels

FEATURES = (
    "log_words", "mean_word", "symbols", "bars", "exclamations", "upper", "digits", "repeated_neighbours", "distinct_words",
    "repeated_lines", "words_per_line", "marks", "beyond_ascii", "top_word", "entropy", "repeated_triples",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)
_MARKS = np.frombuffer(b".,;:?!", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The values of FEATURES for one text; shares are of characters or words."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    p = counts[counts > 0] / size
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        float(counts[_SYMBOLS].sum()) / size,
        float(counts[124]) / n,
        float(counts[33]) / n,
        float(counts[65:91].sum()) / letters,
        float(counts[48:58].sum()) / size,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(seen) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        float(counts[_MARKS].sum()) / n,
        float(counts[128:].sum()) / size,
        max(seen.values(), default=0) / n,
        float(-(p * np.log2(p)).sum()),
        1 - len(triples) / max(1, len(words) - 2),
    ]


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Forest:
    chosen = with_labels(docs, sample_ids(labels, "quality", limit))
    chosen = chosen.select(F.struct("doc_id", "y").alias("doc_id"), "text")
    stats = map_texts(chosen, "x array<double>", lambda batch: [[statistics(t) for t in batch]])
    # Repeated ids keep one row, so the sample's bound holds.
    rows = stats.select("doc_id.*", "x").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    forest = train(docs, labels, limit)

    def rows(batch: list[bytes]) -> list[list]:
        return [forest.score(np.array([statistics(t) for t in batch], float))]

    scored = map_texts(docs, "score double", rows)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
