import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import substrings


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    masks = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        masks.append(gone)
    return words, masks


def test_whole_query_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    words, masks = brute([r["text"] for r in rows], 35)
    want = [
        (r["doc_id"], len(w), sum(m), hashlib.sha256(b" ".join(x for x, gone in zip(w, m) if not gone)).hexdigest()) for r, w, m in zip(rows, words, masks)
    ]
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed_intervals(docs).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_its_sql(spark, sf):
    import duckdb

    from keyloom.llm import queries

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = connection.sql(queries.oracle_sql()["op4_substrings"])
    frame = queries.op4_substrings(spark, f"/root/testdata/{sf}")
    found = frame.select(*want.columns).collect()
    assert sorted(frame.columns) == sorted(want.columns) and any(r["n_removed"] for r in found)
    assert sorted(map(tuple, found)) == sorted(want.fetchall())


def test_empty_table_and_clashing_names(no_docs, clashing):
    assert substrings.removed_intervals(no_docs).collect() == []
    row = substrings.removed_intervals(clashing).first()
    assert (row["doc_id"], row["n_words"], row["n_removed"], row["intervals"]) == (1, 3, 0, [])


@pytest.mark.parametrize("slab, bits", [(1, 64), (40, 64), (10**6, 64), (30, 3), (10**6, 0), (50, 8)])
def test_hot_passage_in_slabs_of_any_size(spark, monkeypatch, slab, bits):
    """A passage that most texts share, one that a text repeats itself, and long texts over several segments.

    With few bits of the first hash, windows collide by force, and the second round has to tell them apart.
    """
    monkeypatch.setattr(substrings, "SLAB", slab)
    rnd = random.Random(slab)
    vocabulary = ["w%d" % i for i in range(500)]
    hot = [rnd.choice(vocabulary) for _ in range(9)]
    texts = []
    for i in range(60):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        if i % 3:
            at = rnd.randint(0, len(own))
            own[at:at] = hot
        texts.append("  ".join(own) + "\n")
    texts.append("x y z u v " * 10)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    words, masks = brute(texts, 5)
    found = {r["doc_id"]: r for r in substrings.removed_intervals(rows, width=5, bits=bits).collect()}
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_texts(rows, width=5, bits=bits).collect()}
    for i, (w, m) in enumerate(zip(words, masks)):
        spans = [tuple(s) for s in found[i]["intervals"]]
        assert [any(a <= k < b for a, b in spans) for k in range(len(w))] == m
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert cut[i].encode().split() == [x for x, gone in zip(w, m) if not gone]
        if not any(m):
            assert cut[i] == texts[i]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("counted", [3, 10**6])
def test_rounds_in_memory(monkeypatch, wide, counted):
    """Readers and counters without Spark: segments and parts of any size find the hashes that occur twice or more."""
    monkeypatch.setattr(substrings, "COUNTED", counted)
    monkeypatch.setattr(substrings, "_SEGMENT", 16)
    rnd = np.random.default_rng(counted)
    round_ = substrings.Round(4, 50, wide, (1 << 64) - 1)
    documents = [rnd.integers(0, 40, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in rnd.integers(0, 60, 30)]
    rows = []
    for task in range(3):
        slab = substrings.Slab(round_, task)
        for number in range(task, 30, 3):
            own = documents[number]
            for at in range(0, len(own), 16):
                part = own[at : at + 16]
                slab.add((number, 7), at, len(part), np.arange(len(part)), part, part * np.uint64(3))
                if slab.size >= 50:
                    rows += slab.rows()
                    slab.clear()
        rows += slab.rows()
    settled, entries = {}, {}
    for route, number, data in rows:
        if route < 0:
            n = int(np.frombuffer(data, "<i8", 1)[0])
            entries[number] = np.frombuffer(data, "<i8", 4 * n, 8).reshape(n, 4)
            settled[number] = [substrings._unpack_places(data, 8 + 32 * n)[0]]
    for route in range(16):
        blocks = [(number, data) for r, number, data in rows if r == route]
        for number, data in substrings._count_route(blocks, round_) if blocks else ():
            settled[number].append(substrings._unpack_places(data)[0])
    # The wide round tells what is not repeated: all places but the settled ones and these are.
    found = set()
    for number, parts in settled.items():
        own = set(np.concatenate(parts).tolist()) if not wide else set(parts[0].tolist())
        if wide:
            gone = set(np.concatenate(parts[1:]).tolist()) if parts[1:] else set()
            own = set(range(int(entries[number][:, 3].sum()))) - gone
        at = 0
        for key, _, base, count in entries[number].tolist():
            found |= {(key, base + p - at) for p in own if at <= p < at + count}
            at += count
    seen = Counter(np.concatenate(documents).tolist())
    assert found == {(i, k) for i, d in enumerate(documents) for k, h in enumerate(d.tolist()) if seen[h] > 1}


def test_copies_without_an_id_share_one_result(spark):
    rnd = random.Random(3)
    text = " ".join("w%d" % rnd.randrange(1000) for _ in range(200))
    rows = [(None, text)] * 300 + [(1, text), (2, " ".join(text.split()[50:90])), (3, " ".join(text.split()[50:80]))]
    found = substrings.removed_intervals(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(found) == 303
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in found} == {(None, 200, 200), (1, 200, 200), (2, 40, 40), (3, 30, 0)}


def test_hashes_are_of_the_window_alone():
    words = [b"%d" % i for i in range(100)]
    for which in (0, 1):
        alone = substrings.window_hashes(words[30:65], 35, which)
        assert substrings.window_hashes(words, 35, which)[30] == alone[0]
        assert len(substrings.window_hashes(words[:34], 35, which)) == 0
    assert substrings.window_hashes(words, 35, 0)[0] != substrings.window_hashes(words, 35, 1)[0]


def test_intervals_are_maximal():
    assert substrings.intervals(np.array([1, 1, 0, 1], bool)) == [(0, 2), (3, 4)]
    assert substrings.intervals(np.zeros(0, bool)) == []
