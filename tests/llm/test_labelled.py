import random
import zlib
from math import comb

import numpy as np
import pytest

from keyloom.llm import gbdt, quality, rules, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def accuracy(rows, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    own = [(truth[r["doc_id"]], r) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(y == r["predicted"] for y, r in own) / len(own), own


@pytest.mark.parametrize(("score", "column", "cutoff"), [(quality.score_quality, "quality", 0.3), (toxicity.score_toxicity, "toxic", 0.5)])
def test_held_out_rows(tables, score, column, cutoff):
    rows = score(*tables).collect()
    assert len(rows) == tables[0].count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cutoff)
    right, own = accuracy(rows, tables[1], column)
    assert right > 0.9
    ones, zeros = ([r["score"] for y, r in own if y == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.75


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edge_cases(score, docs, no_docs, clashing, tables, no_labels):
    rows = score(docs, tables[1]).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert score(no_docs, tables[1]).collect() == []
    assert len(score(clashing, tables[1]).collect()) == 1
    assert {round(r["score"], 6) for r in score(clashing, no_labels).collect()} == {0.5}


def test_labels_of_held_out_rows_change_nothing(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    spoiled = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    get = lambda own: {r["doc_id"]: r["score"] for r in quality.score_quality(docs, own).collect()}
    assert get(labels) == get(spoiled)


def test_trees_learn_an_interaction_and_traversal_matches_a_walk():
    rnd = np.random.default_rng(0)
    x = rnd.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    forest = gbdt.fit(x, y, trees=40)
    p = forest.score(x)
    assert np.mean((p > 0.5) == y) > 0.95
    for i in range(20):
        margin = forest.base
        for root in forest.roots:
            at = root
            while forest.left[at] != at:
                at = forest.left[at] if x[i, forest.feature[at]] <= forest.cut[at] else forest.right[at]
            margin += forest.value[at]
        assert abs(1 / (1 + np.exp(-margin)) - p[i]) < 1e-9


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for places in windows.values() if len(places) > 1 for i in places for k in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rule_counts_against_brute_force(docs, no_docs, clashing, tables):
    want = [(r["doc_id"], *brute_counts(r["text"])) for r in docs.select("doc_id", "text").collect()]
    rows = rules.judge(docs, tables[1]).collect()
    found = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert rules.judge(no_docs, tables[1]).collect() == []
    assert rules.judge(clashing, tables[1]).first()["base_failed"]


def test_bound_is_exact():
    for k, n, p in ((0, 50, 0.05), (3, 80, 0.1), (7, 40, 0.3)):
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(np.exp(rules.log_at_most(k, n, p)) - tail) < 1e-9
        assert rules.proven(k, n, p, tail * 1.001) == (k / n <= p) and not rules.proven(k, n, p, tail * 0.999)


def test_paths_tighten_where_bad_texts_are_caught():
    good, bad = np.zeros((2, 101), int), np.zeros((2, 101), int)
    good[:, 0], good[0, 3], good[1, 50] = 5000, 100, 60
    bad[0, 40], bad[1, 0] = 300, 300
    path = rules.lay_path(good, bad)
    assert path[0] == (100, 100) and path[-1][1] == 100  # the second rule catches none
    assert path[-1][0] < 40 and all(a >= b for x, y in zip(path, path[1:]) for a, b in zip(x, y))
    assert rules.lay_path(good, 0 * bad) == [(100, 100)]


def test_settings_keep_the_joint_risk():
    """Good texts that any rule rejects are fewer than allowed; too few good texts prove nothing."""
    assert rules.choose_setting(np.array([0, 3, 300, 5000]), np.array([0, 200, 100, 5]), 0.0125) == 1
    assert rules.choose_setting(np.array([0, 0, 0, 230]), np.array([0, 200, 100, 5]), 0.0125) == 2
    assert rules.choose_setting(np.array([0, 0, 0, 200]), np.array([0, 200, 100, 5]), 0.0125) == 0
    assert rules.choose_setting(np.array([0, 0, 0, 900]), np.array([0, 300, 1, 5]), 0.0125) == 1  # the mildest that catches nearly all


def test_false_rejections_stay_under_the_risk_on_fresh_data():
    rnd = random.Random(5)
    over = 0
    for _ in range(60):
        steps = np.zeros(101, int)  # a text of value v is first rejected at step 100 - v
        for _ in range(3000):
            steps[100 - min(99, int(rnd.expovariate(0.3)))] += 1
        bad = np.r_[np.full(100, 10), 0]
        step = rules.choose_setting(steps, bad, 0.05)
        over += np.exp(-0.3 * (100 - step)) > 0.02  # the true rate of values of 100 - step or more
    assert over / 60 <= 0.1


def brute_kept(rows, labels, risk=rules.RISK, level=rules.LEVEL):
    """The verdict of every (doc_id, text) by plain loops: paths, exact tests with fractions, then all rules on all texts."""
    marks = {}
    for i, y in labels:
        marks[i] = max(y, marks.get(i, 0))
    made = [(i, rules.counts((t or "").encode())) for i, t in rows]
    seen = [(marks[i], rules.stratum(c[0]), rules.shares(c)) for i, c in made if i in marks and not rules.base_failed(c)]
    settings, strata, n_rules = [], len(rules.STRATA) + 1, len(rules.RULES)
    for s in range(strata):
        bad = [x for y, _, x in seen if y == 0]
        others = [x for y, t, x in seen if y == 1 and t != s]
        own = [x for y, t, x in seen if y == 1 and t == s]
        own_bad = [x for y, t, x in seen if y == 0 and t == s]
        over = lambda xs, r, c: sum(x[r] > c for x in xs)
        now, path = [100] * n_rules, [(100,) * n_rules]
        while True:
            options = []
            for r in range(n_rules):
                for c in range(now[r]):
                    gain = over(bad, r, c) - over(bad, r, now[r])
                    if gain > 0:
                        options.append((gain / (over(others, r, c) - over(others, r, now[r]) + 0.5), r, c, gain))
            if not options:
                break
            top = {r: max((w, c, g) for w, q, c, g in options if q == r) for r in {o[1] for o in options}}
            _, _, minus_r, c = max((w, g, -r, c) for r, (w, c, g) in top.items())
            now[-minus_r] = c
            if sum(over(others, r, c) for r, c in enumerate(now)) > 2 * risk * max(1, len(others)):
                break
            path.append(tuple(now))
        rejected = lambda xs, setting: sum(any(a > b for a, b in zip(x, setting)) for x in xs)
        last = 0
        for t in range(1, len(path)):
            k, n = rejected(own, path[t]), len(own)
            if not n or k / n > risk or sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > level / strata:
                break
            last = t
        settings.append(next(p for p in path[: last + 1] if rejected(own_bad, p) >= 0.99 * rejected(own_bad, path[last])))
    kept = [
        not rules.base_failed(c) and all(a <= b for a, b in zip(rules.shares(c), settings[rules.stratum(c[0])])) for _, c in made
    ]
    return [(i, k) for (i, _), k in zip(made, kept)], settings


def test_verdicts_against_brute_force(spark):
    """Whole query with settings that are proven in some strata: sparse good texts, bad ones of several kinds."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(1500):
        n = rnd.choice([30, 40, 120, 150]) if i % 50 else 300
        own, y = [word() for _ in range(n)], int(rnd.random() < 0.7)
        if not y:
            own = [w + rnd.choice(["###", "", "$$"]) for w in own] if i % 2 else [x for w in own for x in (w, w)]
        elif rnd.random() < 0.2:
            own[0] += "#"
        rows.append((i, " ".join(own)))
        if i % 5 < 4:
            labels.append((i, y))
    rows += [(None, "x " * 30), (7000, None), (7001, ""), rows[3], rows[3]]
    labels += [labels[0], (3, 0), (3, 1), (99999, 1)]
    want, settings = brute_kept(rows, labels)
    assert sum(min(s) < 100 for s in settings) == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = [(r["doc_id"], r["kept"]) for r in rules.judge(docs, marks).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sorted([r["doc_id"] for r in rules.keep_good(docs, marks).collect()], key=str) == sorted([i for i, k in want if k], key=str)


@pytest.mark.parametrize("sf", ["0.01"])
def test_query_against_brute_force(spark, sf):
    from keyloom.llm.queries import op8_rules

    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    want, _ = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    assert sorted((r["doc_id"], r["kept"]) for r in op8_rules(spark, f"/root/testdata/sf{sf}").collect()) == sorted(want)


def test_keep_good_is_the_verdict(tables):
    kept = {r["doc_id"] for r in rules.keep_good(*tables).collect()}
    assert kept == {r["doc_id"] for r in rules.judge(*tables).where("kept").collect()}


def hidden(n=6000, seed=1):
    """A hidden label and voters: good, weak, and three copies of noise."""
    rnd = np.random.default_rng(seed)
    y = (rnd.random(n) < 0.2).astype(float)
    vote = lambda hit, miss: np.where(y == 1, rnd.random(n) < hit, rnd.random(n) < miss)
    noise = vote(0.3, 0.3)
    return y, np.column_stack([vote(0.7, 0.02), vote(0.6, 0.05), vote(0.5, 0.05), vote(0.4, 0.1), noise, noise, noise]).astype(float)


def over_all(votes):
    return lambda model, pairs: toxicity.Moments.of(votes, model.posterior(votes), pairs)


def test_label_model_finds_accuracies_and_shares_the_weight_of_copies():
    y, votes = hidden()
    model = toxicity.estimate(votes[:500], y[:500], over_all(votes))
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.93
    assert abs(model.rates[1, 0] - 0.7) < 0.08 and abs(model.rates[0, 0] - 0.02) < 0.02
    assert min(model.weights[:4]) > 0.8 and max(model.weights[4:]) < 0.5


def test_posteriors_come_from_votes_and_mend_wrong_labels():
    """A quarter of the sample's labels is flipped: posteriors differ from labels, and are nearer to the truth."""
    y, votes = hidden()
    rnd = np.random.default_rng(2)
    given = np.where(rnd.random(800) < 0.25, 1 - y[:800], y[:800])
    model = toxicity.estimate(votes[:800], given, over_all(votes))
    own = model.posterior(votes[:800]) > 0.5
    assert np.mean(own != given) > 0.15
    assert np.mean(own == y[:800]) > 0.93 > 0.8 > np.mean(given == y[:800])


def test_moments_add_up():
    y, votes = hidden(300)
    model = toxicity.LabelModel(0.2, toxicity.Moments.of(votes, y, True).rates(), np.ones(votes.shape[1]))
    whole = toxicity.Moments.of(votes, model.posterior(votes), True)
    parts = toxicity.Moments.of(votes[:100], model.posterior(votes[:100]), True) + toxicity.Moments.of(votes[100:], model.posterior(votes[100:]), True)
    assert whole.toxic == parts.toxic and (whole.toxic_votes == parts.toxic_votes).all() and (whole.pairs == parts.pairs).all()


def sample_of(tables, column):
    """(id, label) of learnable labelled rows that have a document, by id."""
    known = {r["doc_id"] for r in tables[0].select("doc_id").collect()}
    return sorted((r["doc_id"], r[column]) for r in tables[1].collect() if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 5)


def test_toxicity_query_against_plain_loops(spark, tables):
    """Terms, label model over all documents, classifier and scores without Spark."""
    from keyloom.llm.queries import op10_toxicity

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in tables[0].collect()}
    sample = sample_of(tables, "toxic")
    y = np.array([v for _, v in sample], float)
    own = [sorted({t for w in toxicity.words_of(texts[i]) for t in toxicity.terms_of(w)}) for i, _ in sample]
    copies = [toxicity.copy_key(texts[i]) for i, _ in sample]
    toxic_copies = {}
    for terms, v, copy in zip(own, y, copies):
        for t in terms if v else ():
            toxic_copies.setdefault(t, set()).add(copy)
    names = sorted(t for t, found in toxic_copies.items() if len(found) >= toxicity.LEAST)
    number = {t: j for j, t in enumerate(names)}
    found = [[number[t] for t in terms if t in number] for terms in own]
    counts = [np.bincount([j for j, _ in {(j, c) for f, v, c in zip(found, y, copies) if v == k for j in f}], minlength=len(names)) for k in (0, 1)]
    ranked = toxicity.ranked_terms(names, counts[1], counts[0], *(len({c for c, v in zip(copies, y) if v == k}) for k in (1, 0)))
    terms = [names[j] for j in toxicity.choose_terms(found, ranked)]
    known = set(terms)

    def matrix(ids):
        votes, facts = [], []
        for i in ids:
            words = toxicity.words_of(texts[i])
            # The whole word if it is a term, else its longest beginning that is one.
            of_words = [max(set(toxicity.terms_of(w)) & known, key=lambda t: (t[0] == "=", len(t)), default=None) for w in words]
            hits = sum(t is not None for t in of_words)
            patterns = toxicity.patterns_of(texts[i], words)
            some = set(of_words)
            signs = [a > b for a, b in zip(patterns, toxicity.THRESHOLDS)] + [hits >= toxicity.LEAST_HITS and hits >= len(words) * d for d in toxicity.DENSITIES]
            votes.append([*(float(t in some) for t in terms), *map(float, signs)])
            facts.append([len(words), hits, *patterns])
        return np.array(votes), np.array(facts)

    every, every_facts = matrix(texts)
    votes, facts = matrix([i for i, _ in sample])
    model = toxicity.learn(y, votes, facts, terms, over_all(every))
    want = dict(zip(texts, model.score(every, every_facts)))
    got = {r["doc_id"]: r["score"] for r in op10_toxicity(spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_quality_query_against_plain_loops(spark, tables):
    from keyloom.llm.queries import op7_quality

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in tables[0].collect()}
    sample = sample_of(tables, "quality")
    forest = gbdt.fit(np.array([quality.statistics(texts[i]) for i, _ in sample]), np.array([v for _, v in sample], float))
    want = {i: forest.score(np.array([quality.statistics(t)]))[0] for i, t in texts.items()}
    got = {r["doc_id"]: r["score"] for r in op7_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_equal_evidence_takes_the_shortest_term(tables):
    with_toxic, with_clean = np.array([50, 50, 50, 1]), np.array([0, 0, 0, 0])
    assert toxicity.ranked_terms(["longer", "abcde", "abcdd", "rare"], with_toxic, with_clean, 500, 1000) == [2, 1, 0]
    assert toxicity.choose_terms([[0, 1], [0, 1, 2], [2]], [2, 1, 0]) == [2, 1]
