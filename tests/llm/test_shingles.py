"""Near duplicates of the pipeline: five-word shingles, similarity 0.8 or more."""

import random

import numpy as np
import pytest

import corpus_pipeline
from paralex.llm import gray, shingles, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Smallest id of each component over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            near = sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if near and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted({min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in label})


def near_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(2000)]
    out = ["", None, " \n", "One", "one", "a b c d", "A b c  d", "a b c d e", "é" * 20_000]
    for size in (20, 60, 120, 400):
        base = rng.choices(vocabulary, k=size)
        for edits in [0, 1, 1, 2, 2, 3, 4, 6, 8, 12] * 3:
            words = list(base)
            for _ in range(edits * size // 120 + (edits > 0)):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block_rows", [1_024, 8])
def test_pipeline_stage_as_over_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", block_rows)
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)


def test_blocks_of_fingerprints_alone_find_what_is_within_four_bits(spark, monkeypatch):
    """Without any MinHash band in common, the operator's own groups link near texts of near fingerprints."""
    monkeypatch.setattr(shingles, "band_keys", lambda values: [int(values.sum() >> np.uint64(1))] if len(values) else [])
    rows = list(enumerate(near_texts()))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(1_000)]
    for _ in range(40):
        words = list(base)
        for i in rng.sample(range(1_000), 2):
            words[i] = f"v{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(words)))
    sets = [plain_set(t) for _, t in rows]
    sims = np.array([gray.majority(shingles.hashes(t)) for _, t in rows], np.uint64)
    close = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(sims[i] ^ sims[j]) <= simhash.DISTANCE]
    near = [(i, j) for i, j in close if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(near) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.one_of_similar(df).collect()}
    # Nodes are compared with the least of their group too, however far: what is linked lies between these.
    label = gray.forest(len(rows), *np.array(near).T)
    assert set(plain_kept(rows)) <= kept <= set(label.tolist()) and len(kept) < len({frozenset(s) for s in sets}) - 20


def test_null_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (9, "a b c d e"), (None, "other words here now"), (5, "five five"), (5, "five five"), (5, "not so five at all"), (5, "five five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_similar(df).collect())
    assert kept == [("5", "five five"), ("5", "not so five at all"), ("9", "a b c d e"), ("None", "other words here now")]
    assert simhash.one_of_similar(df.limit(0)).count() == 0


def test_set_links_join_all_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**48, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.9], rng.integers(0, 2**48, rng.integers(0, 8), dtype=np.uint64)]) for _ in range(150)]
    near = np.array([[shingles.similar(len(np.intersect1d(x, y)), len(x), len(y)) for y in sets] for x in sets])
    want = gray.forest(150, *np.nonzero(np.triu(near, 1)))
    sims = np.array([gray.majority(s * np.uint64(0x9E3779B97F4A7C15)) for s in sets], np.uint64)
    a, b = shingles.set_links(sets, np.arange(150), sims, np.ones(150, bool))
    assert near[a, b].all() and (gray.forest(150, a, b) == want).all() and len(set(want.tolist())) > 1
    assert all((shingles.unpack(shingles.pack(s)) == s).all() for s in sets)
