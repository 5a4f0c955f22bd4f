import numpy as np
import pytest
from pyspark.sql import functions as F

from paralex.functions import arrays
from paralex.functions.text import tokens_words, tokens_ws
from paralex.operators import checkpoints, dense, index, metrics, models, retrieval
from paralex.plans import flows


def texts(spark, values, key):
    return spark.createDataFrame(list(enumerate(values)), f"{key} long, text string")


def ranked(df):
    return [(r["doc_id"], r["score"]) for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"]))]


def test_bm25_with_negative_floor(spark):
    corpus, asked = texts(spark, ["a b", "a b", "c"], "doc_id"), texts(spark, ["a"], "item_id")
    assert ranked(retrieval.top_k_bm25(corpus, asked, 5)) == [(2, 0.0), (1, -0.039054), (0, -0.039054)]
    assert ranked(retrieval.top_k_bm25(corpus, asked, 1)) == [(2, 0.0)]
    assert ranked(retrieval.top_k_bm25(corpus, asked, 0)) == []


def test_bm25_repeated_tokens_and_unmatched(spark):
    corpus, asked = texts(spark, ["x y", "x z z", "w", "v", "u"], "doc_id"), texts(spark, ["x z z", "nothing here"], "item_id")
    out = ranked(retrieval.top_k_bm25(corpus, asked, 3))
    assert out == [(1, 2.691282), (0, 0.302447), (4, 0.0), (4, 0.0), (3, 0.0), (2, 0.0)]


def test_tfidf(spark):
    corpus, asked = texts(spark, ["the cat", "the dog dog", "a bird"], "doc_id"), texts(spark, ["The dog unseen", "zzz"], "item_id")
    out = ranked(retrieval.top_k_tfidf(corpus, asked, 9))
    assert out == [(1, 0.959146), (0, 0.366447), (2, 0.0), (2, 0.0), (1, 0.0), (0, 0.0)]


def test_dense_ties_take_larger_keys(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "item_id long, embedding array<double>")
    assert ranked(dense.top_k_dense(corpus, asked, 2)) == [(2, 2.0), (1, 2.0)]


def vectors_of(kind, n, rng):
    if kind == "clustered":
        return rng.normal(size=(12, 8))[rng.integers(0, 12, n)] * 4 + rng.normal(size=(n, 8)) * 0.05
    if kind == "copies":  # a third of the rows are one vector, the others few
        return np.where(np.arange(n)[:, None] % 3 == 0, 1.0, rng.integers(-1, 2, (n, 8)))
    return rng.normal(size=(n, 8))


@pytest.mark.parametrize("kind", ["clustered", "copies", "independent"])
@pytest.mark.parametrize("small", [False, True])
def test_dense_equals_all_products(spark, monkeypatch, kind, small):
    rng = np.random.default_rng(5)
    corpus, asked = vectors_of(kind, 400, rng), vectors_of(kind, 30, np.random.default_rng(5))
    if small:  # many parts and blocks
        monkeypatch.setattr(dense, "QUERY_BLOCK", 8)
        monkeypatch.setattr(dense, "CORPUS_BYTES", 1_000)
    df = lambda rows, key: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{key} long, embedding array<double>")
    tally = {}
    got = found(dense.top_k_dense(df(corpus, "doc_id"), df(asked, "item_id"), 5, tally=tally))
    scores = np.round(asked @ corpus.T, 6)
    for q, row in enumerate(scores):
        want = sorted(((s, i) for i, s in enumerate(row)), reverse=True)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [s for s, _ in want], atol=2e-6)
    assert tally["pairs"] == 12_000 and tally["products"] <= (3_000 if kind == "clustered" else 12_000)


GOLDENS = [
    ([("the cat sat on the mat", "the cat sat on a mat")], 53.7285, 72.0848),
    ([("a b c d e", "a b x d e")], 30.2138, 26.0),
    ([("the cat sat on", "the cat sat on a mat")], 60.6531, 72.0851),
    ([("a b c", "a b c")], 0.0, 100.0),
    ([("the cat sat on the mat", "the cat sat on a mat"), ("hello there my friend", "hello there my old friend")], 46.5939, 71.7045),
    ([("", "a b c d")], 0.0, 0.0),
    ([("one two three four five", "one two three four five")], 100.0, 100.0),
]


@pytest.mark.parametrize("pairs,bleu,chrf", GOLDENS)
def test_metrics(spark, pairs, bleu, chrf):
    df = spark.createDataFrame(pairs, "prediction string, target string")
    row = metrics.evaluate(df).first()
    assert (row["bleu"], row["chrf"]) == (bleu, chrf)


def test_metrics_by_group_and_empty_table(spark):
    data = [(i, *p) for i, (pairs, _, _) in enumerate(GOLDENS) for p in pairs]
    df = spark.createDataFrame(data, "g int, prediction string, target string")
    got = {r["g"]: (r["bleu"], r["chrf"]) for r in metrics.evaluate(df.repartition(3), ["g"]).collect()}
    assert got == {i: (b, c) for i, (_, b, c) in enumerate(GOLDENS)}
    assert metrics.evaluate(df.limit(0)).first().asDict() == {"bleu": 0.0, "chrf": 0.0}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    out = arrays.with_new_vectors(df, spark.createDataFrame([(9,)], "id long"), "id", "v")
    assert {r["id"]: r["v"] for r in out.collect()}[9] == [2.0, 3.0]


def test_checkpoints(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6), (5, 0.9)], "step long, metric double")
    assert tuple(checkpoints.best_checkpoint(df).first()) == (5, 0.9)
    assert [tuple(r) for r in checkpoints.early_stop(df, 2).collect()] == [(4, 2)]
    assert checkpoints.early_stop(df, 0).count() == checkpoints.early_stop(df, None).count() == checkpoints.early_stop(df, 3).count() == 0


def test_a_failed_call_is_a_value(spark):
    class Flaky:  # local, so that it travels by value
        def generate(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return '{"translation": "ok"}'

    df = spark.createDataFrame([("x",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["response"], r["error"]) for r in models.generate(df, Flaky).collect()}
    assert got["x"] == ('{"translation": "ok"}', None) and got["bad"][0] is None and "no answer" in got["bad"][1]


def test_few_shot_flow(spark):
    train = spark.createDataFrame([("t1", "a b", "A B"), ("t2", "c", "C"), ("t3", "d", "D")], "verse_id string, text_source string, text_target string")
    test = spark.createDataFrame([("q", "a x", "a x y z")], "verse_id string, text_source string, text_target string")
    rows, scores = flows.few_shot(train, test)
    assert rows.select("prediction").first()[0] == "a x"
    prompt = flows.few_shot_prompts(train, test, flows.FewShotOptions(num_few_shot=1)).first()["prompt"]
    assert "Indonesian: a b\nBambam: A B" in prompt and "Bambam: C" not in prompt
    assert scores.count() == 1
    shown = flows.chat_texts(test, "S", "T", training=False).filter(F.col("text").endswith("<|assistant|>\n"))
    assert shown.columns == ["verse_id", "text_source", "text_target", "text"] and shown.count() == 1



def plain_bm25(texts, asked, k):
    import math
    from collections import Counter

    tf = {i: Counter(t.split()) for i, t in texts}
    df = Counter(t for c in tf.values() for t in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = {}
    for q, text in asked:
        scores = []
        for i, c in tf.items():
            dl = sum(c.values())
            scores.append((round(sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in text.split() if t in c), 6), i))
        out[q] = [(i, s) for s, i in sorted(scores, reverse=True)[:k]]
    return out


def random_texts(n, seed):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n)]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("block,probed,share", [(128, 80, 0.8), (2, 1, 0.5), (1, 2, 1.0)])
def test_pruned_search_equals_all_sums(spark, monkeypatch, block, probed, share):
    from paralex.operators import pruning

    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(pruning, "PROBED", probed)
    monkeypatch.setattr(pruning, "SHARE", share)
    monkeypatch.setattr(pruning, "PAIRS", 50)
    corpus, asked = random_texts(200, 1), random_texts(12, 2)
    tally = {}
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = found(retrieval.top_k_bm25(df(corpus, "doc_id"), df(asked, "item_id"), 3, tally=tally))
    want = plain_bm25(corpus, asked, 3)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q]))
    if block == 2:
        assert tally["sums"] < 0.5 * 12 * 200


def test_a_kept_index(spark, tmp_path, monkeypatch):
    corpus, asked = random_texts(120, 3), spark.createDataFrame(random_texts(6, 4), "item_id long, text string")
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for name, find, tokens in (("b", retrieval.top_k_bm25, tokens_ws), ("t", retrieval.top_k_tfidf, tokens_words)):
        held = index.Index(spark, f"file://{tmp_path}/{name}", tokens)
        with pytest.raises(ValueError):
            held.corpus()
        held.append(df(corpus[:70]))
        assert found(find(None, asked, 4, held=held)) == found(find(df(corpus[:70]), asked, 4))
        held.append(df(corpus[70:]))
        want = found(find(df(corpus), asked, 4))
        assert found(find(None, asked, 4, held=held)) == want
        with monkeypatch.context() as m:  # the second time nothing is counted or weighted again
            m.setattr(index, "counted", None)
            m.setattr(index, "blocks_of", None)
            assert found(find(None, asked, 4, held=held)) == want
