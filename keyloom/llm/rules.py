"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Each rule rejects a text when a share (of symbols, shouting, repeats ...) is over its cutoff. In each stratum of text lengths
all rules together may reject at most ``risk`` of the good texts that pass the base rules. Cutoffs are tightened along a path
of joint settings, from none at all: each step moves one rule's cutoff to where it catches most labelled bad texts for the good
ones that it costs. The path of a stratum is laid with the bad texts and with the good texts of the other strata, so it does not
depend on the good texts that test it. These are the holdout: going down the path, each setting is tested by the exact
(Clopper-Pearson) upper bound of the stratum's good texts that any rule rejects, and the first failure ends the sequence.
Testing in a fixed order needs no correction within a stratum; over strata the level is divided by their number (Bonferroni).
Among the proven settings the mildest that catches nearly all bad texts that any of them catches is used. A stratum with too few
good texts to prove a setting (some 220 at the defaults) has none, and rejects nothing but what the base rules do.

Every labelled row counts, a repeated id once (as good if any of its rows says so). Only counts by (stratum, rule, share in
hundredths) and by (stratum, step) come to the driver. Null and empty texts have no words and fail the base rules; an empty table
gives no rows. Rows with a null id are judged, and not learnt from; repeated rows are judged alike. A share equal to its cutoff
is not over it. Texts of any length are counted whole. Columns beside the two that are read do not matter, also where their
names differ from these only in case.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import materialize, pick, ship

from .common import SLICE, map_texts, release
from .substrings import covered, window_hashes

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
STRATA = (50, 200, 1000)
RULES = ("symbols", "shouting", "neighbours", "bars", "lines")
RISK, LEVEL = 0.02, 0.05
_SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_shouted long, n_neighbours long, n_bars long, n_lines long"


def counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = text.split()
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    blanks = int(octets[9:14].sum() + octets[32])
    points = len(text) - int(octets[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    hashes = window_hashes(words, WINDOW)
    repeated = 0
    if len(hashes):
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        places = np.flatnonzero(times[which] > 1).tolist()
        # Equal hashes only name candidates: the words decide.
        seen = Counter(tuple(words[p : p + WINDOW]) for p in places)
        places = np.array([p for p in places if seen[tuple(words[p : p + WINDOW])] > 1], np.int64)
        repeated = int(covered(len(words), places, WINDOW).sum()) if len(places) else 0
    return (
        len(words),
        points - blanks,
        sum(int(octets[c]) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        int(octets[33]),
        sum(a == b for a, b in zip(words, words[1:])),
        int(octets[124]),
        len(lines),
    )


def base_failed(c) -> bool:
    return c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEATED * c[0]


def shares(c) -> list[int]:
    """For each rule, the number of cutoffs 0.00, 0.01 ... 0.99 that its share exceeds."""
    pairs = ((c[2], c[1]), (c[5], c[0]), (c[6], c[0]), (c[7], c[0]), (c[3], c[8]))
    return [min(100, -(-100 * a // b)) if b else 0 for a, b in pairs]


def stratum(n_words: int) -> int:
    return sum(n_words >= s for s in STRATA)


def log_at_most(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial with n draws of probability p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    most = max(logs)
    return most + math.log(sum(math.exp(x - most) for x in logs))


def proven(k: int, n: int, allowed: float, level: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound of a probability with k of n hits is at most ``allowed``."""
    return n > 0 and k / n <= allowed and log_at_most(k, n, allowed) <= math.log(level)


#: A joint setting of all rules' cutoffs in hundredths; 100 is none.
Setting = tuple[int, ...]


def lay_path(good: np.ndarray, bad: np.ndarray, risk: float = RISK) -> list[Setting]:
    """Settings from none at all to stricter ones.

    ``good[r, b]`` and ``bad[r, b]`` count texts whose share exceeds exactly b cutoffs of rule r. Each step takes the rule and
    cutoff with most bad texts a good one; the path ends where good texts lost by any rule, added up, pass the risk twice.
    """
    rules = len(good)
    lost, caught = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1][:, 1:] for x in (good, bad))  # over cutoff 0, 1 ... 99
    none = np.zeros((rules, 1), np.int64)
    lost, caught = np.hstack([lost, none]), np.hstack([caught, none])
    allowed = 2 * risk * max(1, int(good[0].sum()))
    now, path = [100] * rules, [(100,) * rules]
    while True:
        best = (0.0, 0, 0, 0)
        for r in range(rules):
            gain, cost = caught[r] - caught[r, now[r]], lost[r] - lost[r, now[r]]
            worth = gain[: now[r]] / (cost[: now[r]] + 0.5)
            if now[r] and worth.max() > 0:
                c = int(np.flatnonzero(worth == worth.max())[-1])  # the mildest of equals
                best = max(best, (float(worth[c]), int(gain[c]), -r, c))
        if not best[1]:
            return path
        now[-best[2]] = best[3]
        if sum(lost[r, c] for r, c in enumerate(now)) > allowed:
            return path
        path.append(tuple(now))


def choose_setting(good: np.ndarray, bad: np.ndarray, level: float, risk: float = RISK) -> int:
    """The step of a path that is used. ``good[t]`` and ``bad[t]`` count texts that step t is the first to reject."""
    n, over_good, over_bad = int(good.sum()), np.cumsum(good[:-1]), np.cumsum(bad[:-1])  # the last: rejected by none
    proven_to = 0
    for t in range(1, len(over_good)):
        if not proven(int(over_good[t]), n, risk, level):
            break
        proven_to = t
    return int(np.flatnonzero(over_bad[: proven_to + 1] >= 0.99 * over_bad[proven_to])[0])


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, stratum, shares): one row per document."""

    def rows(batch: list[bytes]) -> list[list]:
        made = [counts(t) for t in batch]
        return [*map(list, zip(*made)), [base_failed(c) for c in made], [stratum(c[0]) for c in made], [shares(c) for c in made]]

    return map_texts(docs, COUNTS + ", base_failed boolean, stratum int, shares array<int>", rows)


def calibrate(counted: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> list[Setting]:
    """The setting of each stratum. ``counted`` is read twice: give what is cheap to read."""
    marks = pick(labels, doc_id="doc_id", y="quality").where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    judged = counted.where("not base_failed").select("doc_id", "stratum", "shares").join(marks, "doc_id")
    strata = len(STRATA) + 1
    found = np.zeros((2, strata, len(RULES), 101), np.int64)
    for r in judged.select("stratum", "y", F.posexplode("shares").alias("rule", "share")).groupBy("stratum", "y", "rule", "share").count().collect():
        found[int(r["y"] == 1), r["stratum"], r["rule"], r["share"]] += r["count"]
    paths = [lay_path(found[1].sum(axis=0) - found[1][s], found[0].sum(axis=0), risk) for s in range(strata)]
    # The first step whose setting rejects a text.
    limits = F.array(*[F.array(*[F.array(*map(F.lit, setting)) for setting in path]) for path in paths])
    over = lambda setting: F.exists(F.zip_with("shares", setting, lambda share, cutoff: share > cutoff), lambda x: x)
    rejects = F.transform(F.element_at(limits, F.col("stratum") + 1), over)
    step = F.coalesce(F.array_position(rejects, True).cast("int") - 1, F.lit(-1))
    tested = [np.zeros((2, len(path) + 1), np.int64) for path in paths]
    for r in judged.select("stratum", "y", step.alias("step")).groupBy("stratum", "y", "step").count().collect():
        at = r["step"] if r["step"] >= 0 else -1
        tested[r["stratum"]][int(r["y"] == 1), at] += r["count"]
    return [path[choose_setting(t[1], t[0], level / strata, risk)] for path, t in zip(paths, tested)]


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(doc_id, counts, base_failed, kept, broken): ``broken`` lists the rules that reject the text."""
    counted = materialize(document_counts(docs), "counts")
    cutoffs = calibrate(counted, labels, risk, level)
    limits = F.array(*[F.array(*[F.lit(int(c)) for c in row]) for row in cutoffs])
    own = F.element_at(limits, F.col("stratum") + 1)
    broken = F.filter(
        F.transform(F.array(*map(F.lit, RULES)), lambda name, i: F.when(F.get("shares", i) > F.get(own, i), name)), lambda x: x.isNotNull()
    )
    out = counted.withColumn("broken", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("stratum", "shares")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    Texts are counted twice, for the cutoffs (numbers alone are written) and for the verdict: that costs less than moving texts to
    their labels or rows to their verdicts. Only the text goes to Python, and only the verdict comes back.
    """
    cutoffs = calibrate(materialize(document_counts(docs), "counts", few=True), labels, risk, level)
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keep = []
            for at in range(0, len(batch), SLICE):
                for text in batch.slice(at, SLICE).to_pylist():
                    c = counts(text)
                    own = cutoffs[stratum(c[0])]
                    keep.append(not base_failed(c) and all(b <= limit for b, limit in zip(shares(c), own)))
            yield pa.array(keep, pa.bool_())
        release()

    return docs.where(good(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
