"""Providers, batches, the encoder and the command line, against a server of this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from paralex import cli
from paralex.functions import arrays
from paralex.operators import dense, models, retrieval
from paralex.plans import flows
from paralex.sources import sinks


@pytest.fixture(scope="module")
def server():
    """Speaks the chat protocol: answers with the text asked for; every first call of a prompt may fail."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            prompt = body["messages"][0]["content"]
            if "always fails" in prompt:
                self.send_error(500)
                return
            answer = {"choices": [{"message": {"content": models.EchoTranslator().generate(prompt)}}]}
            data = json.dumps(answer).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/v1/", seen
    made.shutdown()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tagged verses of one pair: 30 of the training books, 5 of another."""
    path = str(tmp_path_factory.mktemp("verses"))
    rows = [(f"MAT_{i}_1", f"satu dua kata {i} " + "abc"[i % 3], f"one two word {i} " + "abc"[i % 3], "ind-ptu") for i in range(30)]
    rows += [(f"GEN_{i}_1", f"satu dua kata {i}", f"satu dua kata {i}", "ind-ptu") for i in range(5)]
    spark.createDataFrame(rows, "verse_id string, text_source string, text_target string, pair string").write.partitionBy("pair").mode("overwrite").parquet(path)
    return path


def test_request_and_answer(spark, server):
    url, seen = server
    seen.clear()
    model = models.ChatTranslator("gpt-x", url, "secret")
    assert json.loads(model.generate("Translate\n\nIndonesian: apa ini\nBambam:")) == {"translation": "apa ini"}
    path, key, body = seen[0]
    assert (path, key) == ("/v1/chat/completions", "Bearer secret") and "secret" not in repr(model)
    assert body == {
        "model": "gpt-x", "messages": [{"role": "user", "content": "Translate\n\nIndonesian: apa ini\nBambam:"}],
        "response_format": {"type": "json_object"}, "temperature": 0.0, "max_tokens": 1000,
    }
    assert models.answer_text({}) == models.answer_text({"choices": [{"message": {"content": None}}]}) == ""


def test_providers_and_credentials(monkeypatch):
    for name in models.KEY_VARIABLES.values():
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(KeyError):
        models.translator("gpt-4o")
    assert models.translator("gemini-2.0-flash")().base_url == models.BASE_URLS["gemini"]
    assert models.translator("gpt-4o", "http://x/")().key is None
    monkeypatch.setenv(models.KEY_VARIABLES["gpt"], "k")
    made = models.translator("my-gpt-4o")()
    assert (made.key, made.base_url) == ("k", models.BASE_URLS["gpt"])
    with pytest.raises(ValueError):
        models.translator("other")


def test_failed_calls_are_tried_again(spark, server):
    url, seen = server
    seen.clear()
    rows = spark.createDataFrame([("always fails",), ("a\n\nX: b\nY:",)], "prompt string")
    got = {r["prompt"]: r for r in models.generate(rows, models.translator("gemini", url), retries=1).collect()}
    assert got["always fails"]["response"] is None and "500" in got["always fails"]["error"]
    assert json.loads(got["a\n\nX: b\nY:"]["response"]) == {"translation": "b"} and len(seen) == 3


@pytest.fixture
def shouting():
    """Makes a local model that shows the size of its batches and its options; workers get the class by value."""

    class Shouting:
        def __init__(self, decoding):
            self.decoding = decoding

        def generate_many(self, prompts):
            if "bad" in prompts:
                return prompts[:-1]
            return [f"<think>x</think> {p.upper()} {len(prompts)} {self.decoding.num_beams} {self.decoding.max_length}" for p in prompts]

    return Shouting


def test_batches_keep_order(spark, shouting):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "id int, prompt string").coalesce(1)
    out = models.generate_batches(rows, shouting, decoding=models.Decoding(max_length=9, num_beams=4, batch_size=3)).collect()
    assert [r["response"].split("> ")[1] for r in sorted(out, key=lambda r: r["id"])] == [f"P{i} {3 if i < 6 else 1} 4 9" for i in range(7)]
    broken = spark.createDataFrame([("bad",)], "prompt string")
    row = models.generate_batches(broken, shouting).first()
    assert row["response"] is None and "0 answers to 1" in row["error"]


def test_encoder_and_dense_flow(spark):
    rows = spark.createDataFrame([("a", "satu dua"), ("b", "tiga empat"), ("c", None), ("d", "")], "verse_id string, text_source string")
    got = {r["verse_id"]: r["embedding"] for r in models.encode(rows, models.HashEncoder, batch_size=1).collect()}
    assert got["c"] is None and len(got["a"]) == 64 and got["d"] == [0.0] * 64
    train = rows.withColumn("text_target", F.col("text_source"))
    test = spark.createDataFrame([("q", "dua satu", "x")], "verse_id string, text_source string, text_target string")
    options = flows.FewShotOptions(vectorizer="dense", num_few_shot=1, encoder=models.HashEncoder)
    assert "Indonesian: satu dua" in flows.few_shot_prompts(train, test, options).first()["prompt"]


def test_dense_leaves_out_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [0.5, 0.5]), (6, [1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "item_id long, embedding array<double>")
    got = [(r["item_id"], r["rank"], r["doc_id"]) for r in dense.top_k_dense(corpus, asked, 4).orderBy("rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 5)]
    assert dense.top_k_dense(corpus.limit(0), asked, 4).count() == 0


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_k_best_in_parts(monkeypatch, cells):
    import numpy as np

    monkeypatch.setattr(dense, "CELLS", cells)
    rng = np.random.default_rng(1)
    q, c = rng.integers(-2, 3, (6, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    scores, rows = dense._k_best(q, c, 5)
    for i in range(6):
        want = sorted(range(40), key=lambda j: (-(q[i] @ c[j]), j))[:5]
        assert sorted(rows[i].tolist()) == sorted(want) and sorted(scores[i]) == sorted(q[i] @ c[j] for j in want)


def test_queries_that_match_the_last_documents(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPARE", 0)
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 2)
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["z", "c", "a b", "a b", "a b", "a b"])], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a"), (1, "c"), (2, "q"), (3, "c z")], "item_id long, text string")
    got = {}
    for r in sorted(retrieval.top_k_bm25(corpus, asked, 3).collect(), key=lambda r: (r["item_id"], r["rank"])):
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"] > 0, r["score"] < 0))
    assert [x[0] for x in got[2]] == [5, 4, 3] and [x[0] for x in got[1]] == [1, 5, 4] and [x[0] for x in got[3]] == [1, 0, 5]
    negative = got[0][0][1:] == (False, False)
    assert [x[0] for x in got[0]] == ([1, 0, 5] if negative else [5, 4, 3])


def test_vocabulary_beyond_broadcast(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i % 7} same") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "w1 w2 same"), (1, "w4")], "item_id long, text string")
    want = [sorted(map(tuple, f(corpus, asked, 4).collect())) for f in (retrieval.top_k_bm25, retrieval.top_k_tfidf)]
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 1)
    assert [sorted(map(tuple, f(corpus, asked, 4).collect())) for f in (retrieval.top_k_bm25, retrieval.top_k_tfidf)] == want


def test_decode_keeps_every_row(spark):
    encoded = spark.createDataFrame([(1, [0, 5, 2]), (2, [0, 2]), (3, []), (4, None), (5, [9]), (1, [6, 5])], "k long, ids array<long>")
    words = spark.createDataFrame([(5, "five"), (6, "six")], "token_id long, token string")
    got = sorted((r["k"], r["text"]) for r in arrays.decode_tokens(encoded, words, "k", (0, 2)).collect())
    assert got == [(1, "five"), (1, "six five"), (2, ""), (3, ""), (4, ""), (5, "")]


def lines(capsys):
    return capsys.readouterr().out


@pytest.mark.parametrize("vectorizer", ["bm25", "tfidf", "dense"])
def test_few_shot_command(spark, server, corpus, tmp_path, vectorizer):
    url, _ = server
    given = ["fewshot", "--dataset", "org/tagged-verse", "--path", corpus, "--output", str(tmp_path), "--model", "x/gemini-y", "--vectorizer", vectorizer, "--base_url", url]
    cli.main(given)
    report = json.loads((tmp_path / "gemini-y" / "results.json").read_text())
    assert report == {"bleu": 100.0, "chrf": 100.0, "failed": 0}
    found = sinks.read_csv(spark, f"{tmp_path}/gemini-y/ind_ptu_{vectorizer}_predictions.csv", "text_source string, text_target string, prediction string")
    assert found.count() == 5


def test_evaluate_commands(spark, corpus, tmp_path, shouting):
    given = ["--dataset", "tagged-verse", "--path", corpus, "--output", str(tmp_path), "--tgt_lang", "ptu"]
    cli.main(["evaluate", *given, "--book_name", "GEN", "--num_beams", "3"], make=shouting)
    report = json.loads((tmp_path / "model" / "results.json").read_text())
    assert set(report) == {"eval_metrics", "results"} and len(report["results"]) == 5
    assert all(r["prediction"].endswith(" 3 128") and r["target"].startswith("satu") for r in report["results"])
    cli.main(["sft-evaluate", *given], make=shouting)
    report = json.loads((tmp_path / "model" / "results.json").read_text())
    assert all("<think>" not in r["prediction"] and "TRANSLATE" in r["prediction"] for r in report["results"])
    answers = spark.createDataFrame([(f"GEN_{i}_1", f"satu dua kata {i}") for i in range(5)], "verse_id string, prediction string")
    sinks.write_csv(answers, f"{tmp_path}/answers.csv")
    cli.main(["evaluate", *given, "--predictions", f"{tmp_path}/answers.csv"])
    assert json.loads((tmp_path / "model" / "results.json").read_text())["eval_metrics"] == {"bleu": 100.0, "chrf": 100.0}
    with pytest.raises(SystemExit):
        cli.main(["evaluate", *given])


def test_preparing_commands(spark, corpus, tmp_path, shouting):
    given = ["--dataset", "tagged-verse", "--path", corpus, "--output", str(tmp_path)]
    cli.main(["translation", *given], make=shouting)
    run = f"{tmp_path}/model-tagged-verse-ind-ptu"
    assert [spark.read.parquet(f"{run}/{s}").count() for s in ("train", "validation", "test")] == [27, 3, 5]
    assert set(json.loads((tmp_path / "model-tagged-verse-ind-ptu" / "results.json").read_text())) == {"test_bleu", "test_chrf"}
    cli.main(["sft-translation", *given])
    texts = spark.read.parquet(f"{run}/train")
    assert texts.columns == ["text"] and "<|assistant|>\none two" in texts.first()["text"]


@pytest.mark.parametrize("n", [0, 1, 2, 40_000])
def test_a_report_is_one_file_at_every_size(spark, tmp_path, n):
    metrics, rows = spark.createDataFrame([(1.0,)], "bleu double"), spark.range(0, n, 1, 7).select("id", F.lit('a"\n,]é').alias("text"))
    for _ in range(2):  # the second replaces the first
        sinks.write_json(metrics, rows, f"{tmp_path}/é/r.json")
    want = {"eval_metrics": {"bleu": 1.0}, "results": [{"id": i, "text": 'a"\n,]é'} for i in range(n)]}
    assert (tmp_path / "é" / "r.json").read_text() == json.dumps(want, indent=2, ensure_ascii=False)
    sinks.write_json(metrics, None, f"{tmp_path}/m.json", "test_")
    assert (tmp_path / "m.json").read_text() == json.dumps({"test_bleu": 1.0}, indent=2)


def test_failures_are_counted(spark, server, tmp_path):
    url, _ = server
    train = spark.createDataFrame([("a", "x", "y")], "verse_id string, text_source string, text_target string")
    test = spark.createDataFrame([("b", "always fails", "y"), ("c", "satu dua", "satu dua")], train.schema)
    options = flows.FewShotOptions(num_few_shot=0, retries=1, wait=0.01)
    rows, scores = flows.few_shot(train, test, models.translator("gemini", url), options)
    got = {r["verse_id"]: r for r in rows.collect()}
    assert got["b"]["prediction"] == "" and "500" in got["b"]["error"] and got["c"]["error"] is None
    assert scores.first()["failed"] == 1


def test_waits_grow_and_honour_the_server(monkeypatch):
    import urllib.error

    waits = []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def failing(code, said=None):
        def call():
            raise urllib.error.HTTPError("u", code, "no", {"Retry-After": said} if said else {}, None)

        return call

    assert "500" in models._tried(failing(500), 3, 1.0)[1] and waits == [1.0, 2.0, 4.0]
    waits.clear()
    models._tried(failing(429, "7"), 2, 1.0)
    assert waits == [7.0, 7.0]
    waits.clear()
    assert models._tried(failing(401), 5, 1.0)[0] is None and waits == []
    models._tried(failing(503, "999999"), 1, 1.0)
    assert waits == [models.LONGEST_WAIT]


def test_a_ledger_asks_only_what_has_no_answer(spark, server, tmp_path):
    url, seen = server
    make = models.translator("gemini", url)
    ledger = models.Ledger(spark, f"file://{tmp_path}/ledger", "gemini")
    rows = spark.createDataFrame([(i, f"t\n\nX: p{i % 3}\nY:") for i in range(6)] + [(6, "always fails"), (7, None)], "id int, prompt string")
    ask = lambda some: {r["id"]: r for r in models.generate(some, make, retries=0, ledger=ledger).collect()}
    seen.clear()
    got = ask(rows.filter("id < 4"))  # a run that came half way
    assert len(seen) == 3 and json.loads(got[3]["response"]) == {"translation": "p0"}
    got = ask(rows.filter("id < 7"))
    assert len(seen) == 4 and len(got) == 7 and "500" in got[6]["error"] and got[5]["error"] is None
    got = ask(rows.filter("id < 7"))  # what failed is asked again
    assert len(seen) == 5 and got[6]["response"] is None
    assert models.Ledger(spark, ledger.path, "other").entries().count() == 0
    assert ask(rows)[7]["id"] == 7


def test_the_key_is_not_sent(monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setenv(models.KEY_VARIABLES["gpt"], "very-secret")
    assert b"very-secret" not in cloudpickle.dumps(models.translator("gpt-4o"))


def test_scopes_of_threads_are_apart(spark):
    import threading

    from paralex import session

    made = {}

    def other():
        made["theirs"] = session.written(spark.range(5))

    with session.scope() as held:
        first, second = session.written(spark.range(3)), session.written(spark.range(4))
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert len(held) == 2
    session.clear_written(spark, held, keep=second)
    assert second.count() == 4 and made["theirs"].count() == 5 and len(held) == 1
    with pytest.raises(Exception):
        first.collect()
