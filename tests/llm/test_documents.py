"""Near duplicates, classifiers and the pipeline."""

import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from paralex.llm import components, folds, langid, quality, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(fps):
    """Label of each fingerprint over all pairs."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(300)]
    out = ["", None, " \x0b\n", "One", "one", "A b\x1cc d", "a b c d", "é" * 20_000]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice((5, 40, 400)))
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out


def test_fingerprints():
    for t in near_copies():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("group_rows", [50_000, 8])
def test_links_as_over_all_pairs(spark, monkeypatch, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    texts = near_copies()
    texts += texts[:20]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    fps = [plain_fingerprint(t) for t in texts]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, plain_components(fps)))}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_a_ball_of_fingerprints_is_dealt_until_groups_fit(spark, monkeypatch):
    """All within four bits of one centre, so that every first group is far too large."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", 400)
    rng = np.random.default_rng(9)
    ball = np.full(6_000, 0x9E3779B97F4A7C15, np.uint64)
    for _ in range(4):
        ball ^= np.uint64(1) << rng.integers(0, 64, len(ball), dtype=np.uint64)
    far = rng.integers(0, 2**64, 500, dtype=np.uint64)
    fps = np.unique(np.r_[ball, far])
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    plain = simhash.block_forest

    def small_only(key, fps, distance):
        sizes = np.diff(np.r_[simhash._starts(key), len(fps)])
        assert (sizes <= 400).all(), sizes.max()
        return plain(key, fps, distance)

    monkeypatch.setattr(simhash, "block_forest", small_only)
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(nodes)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = simhash.forest(len(fps), *np.nonzero(np.triu(near, 1)))
    groups = {}
    for f, w in zip(fps.view(np.int64).tolist(), want.tolist()):
        groups.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set(map(tuple, groups.values()))) == len(groups)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (9, "a b c d e"), (None, "other words here now"), (5, "five five"), (5, "five five"), (5, "not so five at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 9), (9, 9), (None, None), (5, 5), (5, 5), (5, 5)], key=str)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(df).collect())
    assert kept == [("5", "five five"), ("5", "not so five at all"), ("9", "a b c d e"), ("None", "other words here now")]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_group_index_as_over_all_pairs(kind):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 1 if kind == "dense" else 60, dtype=np.uint64)
    fps = base[rng.integers(0, len(base), 1500)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64))
    fps = np.unique(fps)
    rng.shuffle(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = simhash.forest(len(fps), *np.nonzero(np.triu(near, 1)))
    label = simhash.group_forest(fps)
    assert (simhash.forest(len(fps), np.arange(len(fps)), label) == want).all()
    key = np.zeros((len(fps), 4), np.int64)
    a, b = simhash.block_forest(key, fps)
    assert len(a) == len(fps) - len(set(want.tolist()))


@pytest.mark.parametrize("nodes", [10, 10**5, 10**8, 10**12])
def test_choices_meet_every_near_pair(nodes):
    rng, masks = random.Random(1), simhash.choices(nodes)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(difference & m == 0 for m in masks)


def test_gray_rank_counts_through_the_code():
    x = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folds(spark):
    rows = spark.range(50).select("id", folds.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert spark.range(1).select(folds.held_out(F.lit(None).cast("long")).alias("h")).first()["h"]


def labelled(spark, n=400):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices(["the", "house", "stands", "near", "water", "and", "trees."], k=30))
    bad = lambda: " | ".join(rng.choices(["BUY!!", "NOW!!", "x$$$", "cheap***"], k=12))
    docs = [(i, good() if i % 3 else bad(), "en", "s", 1) for i in range(n)]
    labels = [(i, int(bool(i % 3))) for i in range(n)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, quality_score int"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 40 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_quality_without_labels_or_text(spark):
    docs, labels = labelled(spark, 60)
    odd = spark.createDataFrame([(None, "a"), (1000, None), (1001, ""), (1002, "y" * 200_000)], "doc_id long, text string")
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(docs, labels.withColumn("quality", F.lit(1))).collect()} == {1.0}
    got = quality.classify(docs.select("doc_id", "text").unionByName(odd), labels.unionByName(labels)).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.shape("Héllo,!! 12x") == "Aa,! 9a" and quality.shape("") == ""


WORDS = {
    "en": "the and house water with from this that over under where going", "de": "der und haus wasser mit von dieser jener über unter wohin gehen",
    "fr": "le et maison eau avec de ce cela sur sous où aller", "es": "el y casa agua con desde este aquel sobre bajo donde ir",
    "it": "il e casa acqua con da questo quello sopra sotto dove andare", "nl": "het en huis water met van deze die over onder waar gaan",
    "pl": "ten i dom woda z od tego tamto nad pod gdzie idzie", "fi": "se ja talo vesi kanssa tämä tuo yli alla minne menee",
}


@pytest.mark.parametrize("count", [1, 2, 3, 4, 8])
def test_languages_on_held_out_rows(spark, count):
    rng = random.Random(9)
    rows = []
    for i in range(80 * count):
        lang = list(WORDS)[i % count]
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(4, 40))), lang, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(df).join(df.drop("score"), "doc_id").filter("held_out").collect()
    assert len(out) > 5 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95


def test_languages_of_odd_rows(spark):
    rows = [(i, WORDS["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 !? ²", "de"), (103, "x", None), (None, "the house", None), (104, "é" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert [got[i][0] for i in (100, 101, 102)] == ["und"] * 3
    assert got[103][0] in ("en", "de") and got[None][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(count):
    code = langid.codebook(count)
    assert code.shape[0] == count
    for i in range(count):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= max(1, 2 ** (count - 2) if count <= 7 else 4)


def test_grams_do_not_depend_on_parts(monkeypatch):
    text = "ein Haus am Wasser " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PART", 7)
    assert (langid.features(text) == whole).all() and whole.sum() == sum(len(text) + 2 - n + 1 for n in langid.ORDERS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        assert out.join(seen, docs.columns, "left_anti").count() == 0
        seen = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count()
    ids = {r["doc_id"] for r in seen.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == ids
    texts = [r["text"] for r in seen.collect()]
    fps = [plain_fingerprint(t) for t in texts]
    assert plain_components(fps) == list(range(len(fps)))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0)]])
def test_pipeline_of_no_rows_and_of_null_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "doc_id" in out.columns
