import random

import pytest

import corpus_pipeline
from keyloom.llm import secrets, simhash
from keyloom.llm.queries import vocabulary
from keyloom.session import materialize

from .test_labelled import brute_kept
from .test_secrets import brute as brute_secrets
from .test_simhash import jaccard
from .test_substrings import brute as brute_windows
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the whole small table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), "stage")
        out.append((name, docs.collect(), made.collect(), docs.columns, made.columns))
        docs = made
    return {name: rest for name, *rest in out}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "secret scans", "packing"]
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or before == after


def test_rules_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    before, after = stages["quality rules"][:2]
    verdicts, _ = brute_kept([(r["doc_id"], r["text"]) for r in before], [(r["doc_id"], r["quality"]) for r in labels])
    assert sorted(after) == sorted(r for r, (_, kept) in zip(before, verdicts) if kept)


def test_near_duplicates_stage(stages):
    before, after = stages["simhash near-dedup"][:2]
    parent = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if jaccard(before[i]["text"], before[j]["text"]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    first = {}
    for r, p in zip(before, parent):
        first[p] = min(first.get(p, r), r, key=lambda x: x["doc_id"])
    assert sorted(after) == sorted(first.values()) and len(after) < len(before)


def test_passages_stage(stages):
    before, after = stages["substring dedup"][:2]
    words, masks = brute_windows([r["text"] for r in before], 35)
    want = {r["doc_id"]: [w for w, gone in zip(ws, m) if not gone] for r, ws, m in zip(before, words, masks) if not ws or not all(m)}
    assert {r["doc_id"]: r["text"].encode().split() for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_secrets_stage(stages):
    before, after = stages["secret scans"][:2]
    found = {r["doc_id"]: r["text"] for r in after}
    assert len(found) == len(before)
    for r in before:
        assert not brute_secrets(found[r["doc_id"]])
        if not brute_secrets(r["text"]) and "[SECRET]" not in found[r["doc_id"]]:
            assert found[r["doc_id"]] == r["text"]


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"][:2]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in before}
    check_packing([tuple(r) for r in after], texts)


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"][1])


@pytest.mark.parametrize("k", range(4))
def test_stages_take_edge_cases(spark, docs, no_docs, clashing, k):
    stage = corpus_pipeline.STAGES[k][1]
    for frame in (docs, no_docs, clashing):
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        out.collect()


def test_last_stage_takes_edge_cases(spark, docs, no_docs, clashing):
    for frame in (docs, no_docs, clashing):
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()


def test_copies_and_shared_passages_go_and_clean_texts_stay(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, clean[0]) for i in range(30)]
    rows += [(200 + i, f"{' '.join(word() for _ in range(80))} {passage} tail{i}") for i in range(5)]
    rows += [(300, clean[1] + " extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, SF), "stage")
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) >= {0, *range(2, 40)} and not set(found) & set(range(100, 130))
    assert all(found[i] == clean[i] for i in range(2, 40))
    assert all(passage not in t for t in found.values())
    assert simhash.RADIUS == 4 and secrets.KINDS[0] == "assign"
