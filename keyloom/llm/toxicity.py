"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are terms (words and word beginnings) that are surely more frequent in labelled toxic rows of a bounded sample, and
patterns of writing. The label model takes the votes of every document of the table, labelled or not, as noisy signs of a hidden
label. Expectation-maximisation estimates how often each voter fires for either value; labels are a weak check only, the
sample's rates count ``CHECK`` of the whole in each round. From second moments over all documents, less what the hidden label
explains, come the correlations of the voters given the label: their inverse matrix weighs the voters, so voters that repeat
each other share one say. A document's posterior comes from its votes alone, and may contradict its label.

A logistic classifier is trained on the posteriors of the sample's rows, not on their labels, and scores every text. Texts are
read twice: the sample's, and all for their votes, which are written to the shared folder. Bounds: ``SAMPLE`` labelled rows;
``POOL`` terms with most evidence, of which ``TERMS`` that vote differently become voters; terms of up to ``LONGEST`` letters and
whole words, in ``LEAST`` toxic rows or more, where near copies of a text count once. To the driver come the sample's votes, and sums by voter and pair of voters.

Language, source and id are no inputs. Null texts are empty ones and get the score of a text without votes; an empty table gives
no rows; texts of any length are read whole; repeated rows get equal scores, and each counts in the moments. Terms of equal
evidence are taken shortest first, then in alphabetical order. Rows with a null id are scored, not learnt from. Columns beside
those read do not matter, also where their names differ from these only in case. Without labelled rows of both kinds every
score is the base rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.session import materialize

from .bpe import WordTable
from .common import map_texts, released
from .labelled import SAMPLE, held_out, sample_ids, with_labels
from .simhash import STAGE_SHINGLE, shingle_hashes

#: Terms with most evidence that are compared, and those that vote; toxic rows that a term is in, at least.
POOL, TERMS, LEAST = 1_000, 250, 4
SHORTEST, LONGEST = 4, 10
_EDGE = ".,;:!?\"'()[]{}*#%$&|<>-_"
PATTERNS = ("shouting", "capitals", "second_person", "digits", "repeats")
DENSE = ("log_hits", "hit_share", "log_terms", *PATTERNS)
#: The share of words with a term from which on a voter of its own fires, if they are ``LEAST_HITS`` or more: one word may be
#: chance, and so may several in a long text.
DENSITIES, LEAST_HITS = (0.002, 0.01, 0.03), 2
#: Voters that are no terms.
OTHERS = len(PATTERNS) + len(DENSITIES)
#: From which values on a pattern votes.
THRESHOLDS = (0.2, 0.5, 0.2, 0.3, 0.6)
#: The sample's share in the label model's rates, rounds at most, and the least correlation that is one.
CHECK, ROUNDS, CORRELATED = 0.5, 6, 0.1
#: Rows whose votes are a dense matrix at the same time.
_ROWS = 2_048


def words_of(text: bytes) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.decode("utf-8", "replace").lower().split()) if w]


def terms_of(word: str) -> list[str]:
    """The whole word (marked) and its beginnings."""
    return ["=" + word, *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def patterns_of(text: bytes, words: list[str]) -> list[float]:
    n = max(1, len(words))
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(octets[65:91].sum() + octets[97:123].sum()))
    return [
        min(1.0, int(octets[33]) / n),
        int(octets[65:91].sum()) / letters,
        min(1.0, 20 * sum(w in ("you", "your", "du", "tu", "vous") for w in words) / n),
        min(1.0, int(octets[48:58].sum()) / n),
        1 - len(set(words)) / n,
    ]


class Lexicon:
    """Terms by number, looked up a word at a time. A voter's word has one say: that of its longest term."""

    def __init__(self, terms: list[str], one_each: bool):
        self.number = {t: i for i, t in enumerate(terms)}
        order = lambda w: terms_of(w)[:1] + terms_of(w)[:0:-1]
        known = lambda w: [self.number[t] for t in order(w) if t in self.number]
        self.of_word = WordTable(lambda w: tuple(known(w)[:1] if one_each else known(w)))

    def hits(self, words: list[str]) -> tuple[set[int], int]:
        """The terms that occur, and the words that have any."""
        found: set[int] = set()
        total = 0
        for word, n in Counter(words).items():
            if own := self.of_word[word]:
                total += n
                found.update(own)
        return found, total


@dataclass
class LabelModel:
    """Voter j fires at ``rates[y, j]`` given the hidden label y; ``weights`` share a say among correlated voters.

    The first ``abstain`` voters say nothing where they do not fire: that a word of one language is missing is no sign in another.
    """

    base: float
    rates: np.ndarray
    weights: np.ndarray
    abstain: int = 0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """How likely the hidden label is 1, from binary votes (rows, voters); in steps that add up exactly."""
        fires, rests = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        rests[: self.abstain] = 0
        margin = np.log(self.base / (1 - self.base)) + votes @ (self.weights * (fires - rests)) + (self.weights * rests).sum()
        return np.round(2**20 / (1 + np.exp(-np.clip(margin, -60, 60)))) / 2**20


@dataclass
class Moments:
    """Sums over documents: rows, votes, pairs of votes, and the first two weighed by the posterior."""

    n: float
    votes: np.ndarray
    pairs: np.ndarray | None
    toxic: float
    toxic_votes: np.ndarray

    @classmethod
    def of(cls, votes: np.ndarray, posterior: np.ndarray, pairs: bool) -> Moments:
        return cls(len(votes), votes.sum(axis=0), votes.T @ votes if pairs else None, float(posterior.sum()), posterior @ votes)

    def __add__(self, other: Moments) -> Moments:
        pairs = None if self.pairs is None else self.pairs + other.pairs
        return Moments(self.n + other.n, self.votes + other.votes, pairs, self.toxic + other.toxic, self.toxic_votes + other.toxic_votes)

    def rates(self) -> np.ndarray:
        clean = self.n - self.toxic, self.votes - self.toxic_votes
        return np.array([(v + 1) / (n + 4) for n, v in (clean, (self.toxic, self.toxic_votes))])


def shared_weights(moments: Moments, pairs: np.ndarray) -> np.ndarray:
    """What each voter's say is worth beside voters that are correlated with it given the label."""
    share, rates = moments.toxic / moments.n, moments.rates()
    within = pairs / moments.n - share * np.outer(rates[1], rates[1]) - (1 - share) * np.outer(rates[0], rates[0])
    spread = np.sqrt(np.maximum(np.diag(within), 1e-9))
    correlation = np.clip(within / np.outer(spread, spread), 0, 1)
    correlation[correlation < CORRELATED] = 0
    np.fill_diagonal(correlation, 1)
    ridge = 0.1
    return np.clip(np.linalg.solve(correlation + ridge * np.eye(len(correlation)), np.full(len(correlation), 1 + ridge)), 0.02, 1)


def estimate(
    sample: np.ndarray, y: np.ndarray, moments: Callable[[LabelModel, bool], Moments], abstain: int = 0, rounds: int = ROUNDS
) -> LabelModel:
    """The label model. ``moments(model, with_pairs)`` gives the sums over all documents under a model."""
    check = Moments.of(sample, y, True)
    model = LabelModel(float((check.toxic + 1) / (check.n + 2)), check.rates(), shared_weights(check, check.pairs), abstain)
    pairs = None
    for _ in range(rounds):
        found = moments(model, pairs is None)
        pairs = found.pairs if pairs is None else pairs
        mix = lambda a, b: CHECK * a + (1 - CHECK) * b
        # Documents without votes have the base as their posterior, so it is not learnt from posteriors.
        after = LabelModel(model.base, mix(check.rates(), found.rates()), shared_weights(found, pairs), abstain)
        moved = np.abs(after.rates - model.rates).max()
        model = after
        if moved < 1e-3:
            break
    return model


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(OTHERS + len(DENSE)))
    bias: float = 0.0
    labels: LabelModel | None = None

    def score(self, votes: np.ndarray, facts: np.ndarray) -> np.ndarray:
        margin = inputs(votes, facts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


FEATURES = "found array<int>, facts array<double>"


def features(texts: list[bytes], terms: tuple[str, ...], one_each: bool = True) -> list[list]:
    """For each text, the numbers of its terms; and (words, words with a term, patterns ...)."""
    lexicon = _lexicon(terms, one_each)
    out: list[list] = [[], []]
    for text in texts:
        words = words_of(text)
        found, total = lexicon.hits(words)
        out[0].append(sorted(found))
        out[1].append([float(len(words)), float(total), *patterns_of(text, words)])
    return out


def votes_of(found: pa.ListArray, facts: pa.ListArray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(votes, facts) of features: terms first, then patterns, then densities."""
    n = len(found)
    known = np.array(facts.to_pylist(), float).reshape(n, 2 + len(PATTERNS))
    votes = np.zeros((n, terms + OTHERS))
    votes[np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False)), found.flatten().to_numpy(zero_copy_only=False)] = 1
    votes[:, terms : terms + len(PATTERNS)] = known[:, 2:] > np.array(THRESHOLDS)
    votes[:, terms + len(PATTERNS) :] = (known[:, 1:2] >= LEAST_HITS) & (known[:, 1:2] >= known[:, :1] * np.array(DENSITIES))
    return votes, known


def inputs(votes: np.ndarray, facts: np.ndarray) -> np.ndarray:
    """The classifier's inputs: votes, and values of DENSE."""
    words, hits = facts[:, 0], facts[:, 1]
    terms = votes[:, : votes.shape[1] - OTHERS].sum(axis=1)
    return np.column_stack([votes, np.log1p(hits), np.minimum(1.0, 10 * hits / np.maximum(1, words)), np.log1p(terms), facts[:, 2:]])


_LEXICA: dict[tuple, Lexicon] = {}


def _lexicon(terms: tuple[str, ...], one_each: bool) -> Lexicon:
    key = terms, one_each
    if key not in _LEXICA:
        _LEXICA.clear()
        _LEXICA[key] = Lexicon(list(terms), one_each)
    return _LEXICA[key]


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 3.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights for soft labels ``p`` by Newton steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - p) + penalty * w
        curvature = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


def lift_and_certainty(toxic_with: np.ndarray, clean_with: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """How much more frequent terms are in toxic rows (log), and the signed root of the likelihood ratio of no difference."""
    lift = np.log((toxic_with + 0.5) / (max(1, toxic) + 1)) - np.log((clean_with + 0.5) / (max(1, clean) + 1))
    both, share = toxic_with + clean_with, toxic / max(1, toxic + clean)
    part = lambda seen, of: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(both * of, 1e-9))
    ratio = part(toxic_with, share) + part(clean_with, 1 - share)
    return lift, np.sign(lift) * np.sqrt(2 * np.maximum(ratio, 0))


def ranked_terms(terms: list[str], toxic_with: np.ndarray, clean_with: np.ndarray, toxic: int, clean: int, most: int = POOL) -> list[int]:
    """Terms that are surely more frequent in toxic rows, by evidence."""
    lift, z = lift_and_certainty(toxic_with, clean_with, toxic, clean)
    chance = np.sqrt(2 * np.log(max(2, len(terms))))  # what the best of so many terms would show without any effect
    sure = np.flatnonzero((lift > np.log(3)) & (z > chance)).tolist()
    return sorted(sure, key=lambda j: (-round(float(z[j]), 6), len(terms[j]), terms[j]))[:most]


def choose_terms(found: list[list[int]], ranked: list[int], most: int = TERMS) -> list[int]:
    """Of terms that are in the same rows, the first by rank is enough. ``found`` lists the terms of each row."""
    place = {j: k for k, j in enumerate(ranked)}
    present = np.zeros((len(found), len(ranked)), bool)
    for i, own in enumerate(found):
        present[i, [place[j] for j in own if j in place]] = True
    first: dict[bytes, int] = {}
    for k, j in enumerate(ranked):
        first.setdefault(np.packbits(present[:, k]).tobytes(), j)
    return list(first.values())[:most]


def _moments(voted: DataFrame, terms: int, model: LabelModel, pairs: bool) -> Moments:
    """The sums over all documents, added up by voter and pair of voters where the votes are read."""
    width = terms + OTHERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(0, np.zeros(width), np.zeros((width, width)) if pairs else None, 0.0, np.zeros(width))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                votes, _ = votes_of(part.column(0), part.column(1), terms)
                total += Moments.of(votes, model.posterior(votes), pairs)
        square = np.zeros((3, width + 1))
        square[0, :width], square[1, :width], square[2, :2] = total.votes, total.toxic_votes, (total.n, total.toxic)
        every = np.vstack([square[:, :width], total.pairs]) if pairs else square[:, :width]
        i, j = np.nonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(every[i, j])], names=["i", "j", "value"])

    sums = voted.select("found", "facts").mapInArrow(released(run), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    every = np.zeros((3 + width, max(2, width)))
    for r in sums.collect():
        every[r["i"], r["j"]] = r["value"]
    return Moments(every[2, 0], every[0, :width], every[3:, :width] if pairs else None, float(every[2, 1]), every[1, :width])


def learn(y: np.ndarray, votes: np.ndarray, facts: np.ndarray, terms: list[str], moments: Callable[[LabelModel, bool], Moments]) -> Model:
    """The classifier, from the sample's votes and the sums over all documents."""
    labels = estimate(votes, y, moments, votes.shape[1])
    w = fit_linear(np.column_stack([inputs(votes, facts), np.ones(len(y))]), labels.posterior(votes))
    return Model(terms, w[:-1], float(w[-1]), labels)


def base_rate(y: np.ndarray) -> float:
    share = (y.sum() + 1) / (len(y) + 2)
    return float(np.log(share / (1 - share)))


def copy_key(text: bytes) -> int:
    """The least hash of a text's shingles: near copies mostly share it, other texts do not."""
    hashes = shingle_hashes(text, STAGE_SHINGLE)
    return int(hashes.min().view(np.int64)) if len(hashes) else 0


def lexicon_terms(chosen: DataFrame) -> tuple[list[str], np.ndarray]:
    """(voters' terms, labels) of the sample (doc_id as (doc_id, y), text). Copies of a text count once for a term."""

    def distinct_terms(batch: list[bytes]) -> list[list]:
        return [[sorted({t for w in set(words_of(text)) for t in terms_of(w)}) for text in batch], list(map(copy_key, batch))]

    toxic = map_texts(chosen.where("doc_id.y = 1"), "terms array<string>, copy long", distinct_terms).select("copy", F.explode("terms").alias("term"))
    names = sorted(r["term"] for r in toxic.groupBy("term").agg(F.count_distinct("copy").alias("n")).where(F.col("n") >= LEAST).collect())
    every = map_texts(chosen, FEATURES + ", copy long", lambda batch: [*features(batch, tuple(names), False), list(map(copy_key, batch))])
    # A repeated id counts once.
    row = F.min(F.struct("found", "copy")).alias("row")
    once = materialize(every.select("doc_id.*", "found", "copy").groupBy("doc_id").agg(F.max("y").alias("y"), row).select("doc_id", "y", "row.*"), "found")
    y = np.array([r["y"] for r in once.orderBy("doc_id").select("y").collect()], float)
    with_term, rows = np.zeros((2, len(names)), np.int64), [0, 0]
    for r in once.select("y", "copy", F.explode("found").alias("term")).groupBy("y", "term").agg(F.count_distinct("copy").alias("n")).collect():
        with_term[int(r["y"] == 1), r["term"]] = r["n"]
    for r in once.groupBy("y").agg(F.count_distinct("copy").alias("n")).collect():
        rows[int(r["y"] == 1)] = r["n"]
    ranked = ranked_terms(names, with_term[1], with_term[0], rows[1], rows[0])
    own = once.orderBy("doc_id").select(F.array_intersect("found", F.array(*map(F.lit, ranked)).cast("array<int>")).alias("found")).collect() if ranked else []
    return [names[j] for j in choose_terms([r["found"] for r in own], ranked)], y


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model, and every document's features (doc_id, FEATURES)."""
    chosen = materialize(with_labels(docs, sample_ids(labels, "toxic", limit)).select(F.struct("doc_id", "y").alias("doc_id"), "text"), "sample")
    terms, y = lexicon_terms(chosen)
    make = lambda batch: features(batch, tuple(terms))
    voted = materialize(map_texts(docs, FEATURES, make), "votes")
    if not len(y) or y.min() == y.max():
        return Model(terms, np.zeros(len(terms) + OTHERS + len(DENSE)), base_rate(y)), voted
    own = map_texts(chosen, FEATURES, make).select("doc_id.*", "found", "facts").groupBy("doc_id").agg(F.min(F.struct("found", "facts")).alias("v"))
    values = own.orderBy("doc_id").select("v.*").toArrow().combine_chunks()
    votes, facts = votes_of(*(values[c].combine_chunks() for c in ("found", "facts")), len(terms))
    return learn(y, votes, facts, terms, lambda model, pairs: _moments(voted, len(terms), model, pairs)), voted


def score_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    model, voted = train(docs, labels, limit)
    id_type = voted.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                scores = model.score(*votes_of(part.column(1), part.column(2), len(model.terms)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = voted.mapInArrow(released(run), StructType().add("doc_id", id_type).add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
