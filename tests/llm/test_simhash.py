import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom import session
from keyloom.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """Component number of each print."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_whole_query_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    parts = brute_components(prints)
    least = {p: min((r["doc_id"] for r, q in zip(rows, parts) if q == p and r["doc_id"] is not None), default=None) for p in parts}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((r["doc_id"], f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, parts)), key=key)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key) == want


def test_one_print_of_most_rows(spark):
    """Empty texts without an id, mass copies, and prints near to them."""
    rnd = random.Random(4)
    text = " ".join("w%d" % rnd.randrange(1000) for _ in range(300))
    rows = [(None, "")] * 200 + [(i, " ") for i in range(50, 250)] + [(i, text) for i in range(1000, 1400)] + [(7, text + " w1"), (2000, "alone here")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    prints = {t: brute_print(t) for _, t in rows}
    assert (prints[text] ^ prints[text + " w1"]).bit_count() <= 4
    want = [(i, f"{prints[t]:016x}", 50 if not t.strip() else 2000 if i == 2000 else 7) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.keep_one])
def test_nothing_that_grows_is_broadcast(spark, docs, operator):
    """A broadcast goes through the driver: some 10 MB of compressed rows, times the salts, were more than its memory."""
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = ran().size()
    operator(docs).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [ran().apply(i).physicalPlanDescription() for i in range(before, ran().size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_fingerprint_hash_is_sparks(spark):
    shingle = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert simhash.fingerprint(b"A b\tc\nD") == shingle & (1 << 64) - 1


def test_empty_table_and_clashing_names(no_docs, clashing):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert [tuple(r) for r in simhash.near_duplicates(clashing).collect()] == [(1, f"{brute_print('right words here'):016x}", 1)]


def cluster(seed, n, spread):
    """Prints around a few centres: chains and dense groups."""
    rnd = random.Random(seed)
    out = set()
    centres = [rnd.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, spread)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("spread", "cell", "blocks"), [(3, 16_384, 6), (9, 16_384, 5), (9, 8, 6), (12, 16, 7)])
def test_links_of_dense_groups_in_cells(spark, spread, cell, blocks):
    prints = cluster(spread, 150, spread)
    signed = [simhash._signed(p) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["u"]: r["root"] for r in simhash.components(simhash.close_edges(frame, blocks=blocks, cell=cell)).collect()}
    want = brute_components(prints)
    groups = {}
    for p, c in zip(signed, want):
        groups.setdefault(c, []).append(p)
    assert found == {p: min(g) for g in groups.values() for p in g if p != min(g)}


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1001, 1000)], "u long, v long")
    found = {r["u"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_every_close_pair_shares_a_bucket():
    rnd = random.Random(3)
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_masks(blocks)
        for _ in range(200):
            bits = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not m & bits for m in masks)


def test_spanning_edges_are_a_forest():
    prints = np.array([simhash._signed(p) for p in cluster(5, 300, 4)])
    members, roots = simhash.spanning_edges(prints)
    assert len(set(members.tolist())) == len(members)
    assert not set(members.tolist()) & set(roots.tolist())


def test_keep_one_keeps_one_row_of_each_component(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_components([brute_print(r["text"]) for r in docs.collect()])))
    assert {r["doc_id"] for r in kept.collect()} >= {4, 5, 6}


def test_rows_that_differ_in_another_column_only(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, None), (2, text, "c"), (3, "other text of its own here", "d"), (3, "other text of its own here", "d")]
    rows += [(None, "third text, no id at all", "e"), (None, "third text, no id at all", "f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"]) == [(1, text), (3, rows[4][1])]
    assert [r["text"] for r in kept if r["doc_id"] is None] == [rows[6][1]]
    assert all(tuple(r) in rows for r in kept)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("cell", [simhash.SET_CELL, 4])
def test_stage_links_at_similarity_of_point_eight(spark, cell):
    """Copies with a few words changed differ in far more than four bits; those at 0.8 or more go, others stay."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        for changed in (0, 1, 2, 3, 4, 5, 6, 8, 12):
            copy = list(base)
            for i in range(changed):
                copy[(i * 200 + 100) // changed] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    prints = [brute_print(t) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in pairs) > len(pairs) / 2
    parent = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            parent[i] = parent[j] = min(parent[i], parent[j])
    kept = {r["doc_id"] for r in simhash.keep_one(docs, cell=cell).collect()}
    assert kept == set(parent) and 12 < len(kept) < n


def test_similarity_is_exact_at_the_bound():
    a = np.arange(10, dtype=np.int64)
    for b, linked in ((np.arange(8), True), (np.arange(7), False), (np.arange(1, 11), True), (np.arange(2, 12), False)):
        members, _ = simhash.similar_links(np.array([5, 3]), [a, b.astype(np.int64)], 0.8)
        assert len(members) == linked


def test_stage_prints_are_simhashes():
    """The stage's candidates come from SimHash: bits by the majority of a set's hashes, and blocks of these bits."""
    rnd = random.Random(6)
    for n in (1, 2, 9, 255, 256, 700):
        members = np.array(sorted(rnd.getrandbits(64) for _ in range(n)), np.uint64)
        wide = simhash.wide_print(members)
        brute = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in members) > n)
        assert len(wide) == simhash.WIDE + 1 and wide[0] == simhash._signed(brute)
        assert len(set(wide.tolist())) == len(wide)
    assert not len(simhash.wide_print(members[:0]))


def test_stage_candidates_against_brute_force(spark):
    rnd = random.Random(8)
    sets = []
    for n in [rnd.randint(4, 60) for _ in range(40)] + [90] * 3:
        base = [rnd.getrandbits(64) for _ in range(n)]
        sets += [np.array(base[: n - cut], np.uint64) for cut in ([0] * 1 + [1, 2, n // 5, n // 3] if n < 90 else range(40))]
    wides = [simhash.wide_print(x) for x in sets]
    frame = spark.createDataFrame([(i, w.tolist(), len(x)) for i, (x, w) in enumerate(zip(sets, wides))], "node long, words array<long>, n long")
    found = {tuple(r) for r in simhash.close_members(frame.repartition(3), 0.8).collect()}
    mask, buckets = (1 << simhash.KEY_BITS) - 1, {}
    for i, w in enumerate(wides):
        for at, word in enumerate(w[1:].view(np.uint64).tolist()):
            for j in range(simhash.KEYS):
                buckets.setdefault((at * simhash.KEYS + j) << simhash.KEY_BITS | word >> simhash.KEY_BITS * j & mask, []).append(i)
    near = lambda i, j: int(wides[i][0] ^ wides[j][0]) % 2**64
    fits = lambda i, j: 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
    want = {(k, i) for k, some in buckets.items() for i in some for j in some if i != j and fits(i, j) and near(i, j).bit_count() <= simhash.STAGE_RADIUS}
    assert found == want and max(map(len, buckets.values())) > simhash._PAIRS
    # Every pair at 0.8 or more has a bucket.
    shared = {(i, j) for k, some in buckets.items() for i in some if (k, i) in found for j in some if (k, j) in found}
    kin = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert len(kin) > 500 and set(kin) <= shared


def test_stage_makes_few_files(spark, docs):
    """Each file costs an executor three processes on a local file system: as many as cores, not as partitions; nothing stays of a write's shuffles."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", session._CLEANUP_KEY)}
    folder = Path(session.work_dir(spark).removeprefix("file://"))
    known = set(folder.glob("*"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = session.few_files(simhash.keep_one(docs))
        assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        made = {p: len(list(p.glob("part-*"))) for p in set(folder.glob("*")) - known}
        assert len(made) > 4 and max(made.values()) <= spark.sparkContext.defaultParallelism
        assert spark.conf.get(session._CLEANUP_KEY, None) == before[session._CLEANUP_KEY]
        # Whole rows move once: the join and the choice of one of equal rows share an exchange.
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") >= 1 and kept._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0].count("Exchange") == 0
        assert kept.count() == len(set(brute_components([brute_print(r["text"]) for r in docs.collect()])))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
