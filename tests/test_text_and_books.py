import pytest
from pyspark.sql import functions as F

from paralex.functions import arrays, prompts, responses, text
from paralex.operators import books, models, splits
from paralex.sources import layout, readers, sinks


def rows(spark, values, schema="v string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_strip_takes_all_white_space(spark):
    out = rows(spark, ["\n x \t", " a ", "", "   ", None]).select(text.strip(F.col("v")).alias("o"))
    assert column(out, "o") == ["x", "a", "", "", None]


def test_tokens(spark):
    out = rows(spark, ["  a b c\n", "", None]).select(text.tokens_ws(F.col("v")).alias("o"))
    assert column(out, "o") == [["a", "b", "c"], [], None]
    out = rows(spark, ["É a étion x_1, B"]).select(text.tokens_words(F.col("v")).alias("o"))
    assert column(out, "o") == [["étion", "x_1"]]
    out = rows(spark, ["3.5 a-b, &quot;c&quot;."]).select(text.tokens_13a(F.col("v")).alias("o"))
    assert column(out, "o") == [["3.5", "a-b", ",", '"', "c", '"', "."]]


def test_ngrams_of_short_texts_are_empty(spark):
    df = rows(spark, ["ab", ""])
    assert column(df.select(text.char_grams(F.col("v"), 3).alias("o")), "o") == [[], []]
    assert column(df.select(text.char_grams(F.col("v"), 2).alias("o")), "o") == [["ab"], []]
    tokens = text.tokens_ws(F.lit("a b c"))
    assert column(rows(spark, ["x"]).select(text.word_grams(tokens, 2).alias("o")), "o") == [["a b", "b c"]]


def test_books_and_splits(spark):
    ids = ["MAT_1_1", "JAB_1_1", "JAS_1_1", "GEN_1_1", "XXX_1_1", "MAT", None]
    out = splits.assign_splits(rows(spark, ids, "verse_id string"))
    got = {r["verse_id"]: (r["book"], r["split"] == "test") for r in out.collect()}
    assert got == {
        "MAT_1_1": ("MAT", False), "JAB_1_1": ("JAB", False), "JAS_1_1": ("JAS", True), "GEN_1_1": ("GEN", True),
        "XXX_1_1": ("XXX", True), "MAT": ("MAT", False), None: (None, True),
    }


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 237])
def test_split_sizes_are_exact(spark, n):
    import math

    df = spark.range(n).select(F.concat(F.lit("MAT_"), "id").alias("verse_id"))
    out = splits.train_validation(df)
    again = splits.train_validation(df.repartition(3))
    assert out.filter("split = 'validation'").count() == math.ceil(0.1 * n)
    assert out.count() == n and sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_references(spark):
    df = spark.createDataFrame([(["MAT 1:1"],), (["1CO 2:3", "1CO 2:4"],), (["  GEN 1:1"],), ([],), (None,)], "ref array<string>")
    assert column(books.with_reference(df), "book") == ["MAT", "1CO", "GEN", None, None]


def test_pairs_by_position_and_by_language(spark):
    schema = "translation struct<language: array<string>, translation: array<string>>"
    df = spark.createDataFrame([((["b", "a"], ["x", "y"]),), ((["a"], ["z"]),)], schema)
    assert column(books.extract_pair(df), "text_target") == ["y", None]
    assert column(books.extract_pair(df, "a", "b"), "text_source") == ["y", "z"]


def test_optional_book(spark):
    df = rows(spark, ["MAT", "GEN"], "book string")
    assert [books.of_book(df, b).count() for b in (None, "", "MAT", "mat")] == [2, 2, 1, 0]


def test_json_answers(spark):
    given = {
        '{"translation": "x"}': "x", '{"other": 1}': "", '{"translation": null}': "", '{"translation": 5}': "5", "{bad": "",
        "{'translation': 'x'}": "", '{"translation": "x"} y': "", '```json\n{"translation": "x"}\n```': "", "": "", '["a"]': "",
    }
    out = rows(spark, list(given)).select("v", responses.json_field(F.col("v")).alias("o"))
    assert {r["v"]: r["o"] for r in out.collect()} == given
    assert column(rows(spark, [None], "v string").select(responses.json_field(F.col("v")).alias("o")), "o") == [""]


def test_thinking(spark):
    df = rows(spark, ["a", "x</think> b ", "1</think>2</think>c", "d</think>"])
    assert column(df.select(responses.after_thinking(F.col("v")).alias("o")), "o") == ["a", "b", "c", ""]


def test_prompts(spark):
    df = spark.createDataFrame([("q", [("a", "b"), ("c", "d")]), ("q", [])], "t string, e array<struct<source:string,target:string>>")
    many, none = column(df.select(prompts.few_shot_prompt(F.col("t"), F.col("e"), "S", "T").alias("o")), "o")
    head = prompts.INSTRUCTION.format(src="S", tgt="T")
    assert many == head + "\n\nHere are some examples:\n\nS: a\nT: b\n\nS: c\nT: d\n\nS: q\nT:"
    assert none == head + "\n\nS: q\nT:"


def test_arrays(spark):
    df = spark.createDataFrame([([1, -100, 3],), ([],)], "a array<int>")
    assert column(df.select(arrays.mask_sentinel(F.col("a"), 0).alias("o")), "o") == [[1, 0, 3], []]
    assert column(df.select(arrays.truncate_pad(F.col("a"), 2, 9).alias("o")), "o") == [[1, -100], [9, 9]]
    assert column(df.select(arrays.truncate_pad(F.col("a"), 4, 9).alias("o")), "o") == [[1, -100, 3, 9], [9, 9, 9, 9]]


def test_dispatch():
    assert models.provider_of("gpt-gemini-x") == "gemini" and models.provider_of("gpt-4") == "gpt"
    with pytest.raises(ValueError):
        models.provider_of("other")
    with pytest.raises(ValueError):
        readers.load(None, None, "", "a", "b")


def test_csv_keeps_all_values(spark, tmp_path):
    values = ["a,b", 'q"uote"', "line\nend", "  padded ", "", None, "\\N?"]
    df = rows(spark, values)
    sinks.write_csv(df.withColumn("w", F.lit("x")), str(tmp_path / "out"))
    back = sinks.read_csv(spark, str(tmp_path / "out"), "v string, w string")
    assert sorted(column(back, "v"), key=repr) == sorted(values, key=repr)


def test_corpora_are_read_by_pair(spark, tmp_path):
    tagged = spark.createDataFrame([("MAT_1", "a", "b", "x-y"), ("GEN_1", "c", "d", "x-y"), ("MAT_1", "e", "f", "y-x")], "verse_id string, text_source string, text_target string, pair string")
    tagged.write.partitionBy("pair").parquet(str(tmp_path / "tagged"))
    out = readers.load(spark, "org/tagged-verse", str(tmp_path / "tagged"), "x", "y")
    assert sorted((r["verse_id"], r["split"]) for r in out.collect()) == [("GEN_1", "test"), ("MAT_1", "validation")]
    multi = spark.createDataFrame([("test", (["x", "y"], ["a", "b"]), ["MAT 1:1"]), ("train", (["x", "z"], ["a", "b"]), ["MAT 1:2"])], "split string, translation struct<language: array<string>, translation: array<string>>, ref array<string>")
    multi.write.partitionBy("split").parquet(str(tmp_path / "multi"))
    out = readers.load(spark, "multi-translation", str(tmp_path / "multi"), "x", "y").collect()
    assert [tuple(r) for r in out] == [("test", "MAT 1:1", "MAT", "a", "b")]
    assert sinks.output_name("org/model", "org/data", "x", "y") == "model-data-x-y"


def test_a_book_is_read_from_its_folder_alone(spark, tmp_path):
    values = [("train", "007", "a", i) for i in range(50)] + [("train", "ROM", None, 2), ("test", None, "c", 3), (None, "ROM", "d", 4)]
    df = spark.createDataFrame(values, "split string, book string, text string, extra int")
    schema = layout.lay_out(df, f"{tmp_path}/all", file_rows=10)
    back = layout.read_laid_out(spark, f"{tmp_path}/all", schema)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    one = layout.read_laid_out(spark, f"{tmp_path}/all", schema, "train", "007")
    assert one.count() == 50 and len(one.inputFiles()) >= 5
    assert all("split=train/book=007" in f for f in one.select("text", F.input_file_name().alias("f")).toPandas()["f"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(book" in plan.split("PartitionFilters")[1].split("]")[0]
    empty = layout.lay_out(df.limit(0), f"{tmp_path}/none")
    assert layout.read_laid_out(spark, f"{tmp_path}/none", empty, "train", "ROM").count() == 0
