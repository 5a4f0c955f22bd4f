"""Sharding, media columns, URL filters and neighbours."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paralex.llm import media, neighbours, ring, urls


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(0).alias("shard"))


def check_shards(rows, n, shards=16):
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(s, ())) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [0, 1, 5, 16, 333, 4001])
def test_counts_differ_by_one(spark, n):
    rows = ring.shard_documents(numbered(spark, n)).collect()
    check_shards(rows, n)
    again = ring.shard_documents(numbered(spark, n).repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_null_and_repeated_keys(spark):
    df = numbered(spark, 300).withColumn("doc_id", F.when(F.col("doc_id") < 150, None).when(F.col("doc_id") < 250, 7).otherwise(F.col("doc_id")))
    df = df.withColumn("text", F.when(F.col("doc_id") > 280, None).otherwise(F.col("text")))
    rows = ring.shard_documents(df.unionByName(df)).collect()
    check_shards(rows, 600)
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if (r["doc_id"] or 0) > 280)


def test_a_new_shard_moves_few_keys_with_slack():
    counts = {c: 50 for c in range(ring.CELLS)}
    homes = []
    for shards in (16, 17):
        home = {}
        for cell, lo, hi, shard, _ in ring.walk(counts, ring.Ring(shards), slack=0.5):
            for k in range(lo, hi):
                home[cell, k] = shard
        homes.append(home)
    moved = sum(homes[0][k] != homes[1][k] for k in homes[0])
    assert len(homes[0]) == len(homes[1]) and moved < 0.2 * len(homes[0])


def test_png_round_trip_of_all_filters():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (7, 12), dtype=np.uint8)
    assert (media.read_png(media.write_png(samples)) == samples).all()
    for step in (1, 3):
        rows = np.zeros((7, 13), np.uint8)
        for y, kind in enumerate([1, 2, 2, 3, 4, 0, 4]):
            rows[y, 0] = kind
            for x in range(12):
                a = int(samples[y, x - step]) if x >= step else 0
                b = int(samples[y - 1, x]) if y else 0
                c = int(samples[y - 1, x - step]) if y and x >= step else 0
                p = a + b - c
                paeth = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
                rows[y, x + 1] = (int(samples[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255
        assert (media._unfilter(rows, step) == samples).all()


def test_damaged_images():
    image = bytearray(media.write_png(np.zeros((2, 576), np.uint8)))
    for at in (0, 20, len(image) - 20):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(media.DamagedImage):
            media.read_png(bytes(bad))


def test_media_digests(spark):
    texts = ["", None, "a", "x" * 576, "é" * 400, "a", "long " * 40_000]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r["doc_id"]: r for r in media.features(media.store(df)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        full = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["tail_crc32"]) == (len(data), len(full), zlib.crc32(full[-32:]))
    assert rows[2]["feature"] == rows[5]["feature"] and rows[2]["media_sha256"] == rows[5]["media_sha256"]
    assert media.features(media.store(df.limit(0))).count() == 0


def url_rule(url):
    """Plain statement of the rules."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, None
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [
    "http://a.example.com/en/712", "http://a.example.com/en/12", "http://EXAMPLE.com/en/7?x=/en/", "https://com/en/", "https://xcom/en/",
    "http://b.example.net/de/81#t", "http://b.example.net/de/91", "http://c.org/es/", "http://c.org/es", "http://c.org?a/es/", "http://c.org#/es/",
    "no scheme/en/", "", None, "http://", "ftp://u:p@h.com:80/en/1", "http://ÄB.com/en/\n/x", "a://b://c.com/en/",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["decided"]) for r in urls.with_rule(df.drop("host")).collect()}
    assert got == {i: url_rule(u) for i, u in enumerate(URLS)}
    judged = urls.judge(df).collect()
    assert {r["verdict"] for r in judged} <= {"allow", "block"} and len(judged) == len(URLS)
    assert all(r["verdict"] == url_rule(URLS[r["page_id"]])[3] for r in judged if r["rule"])
    assert {r["verdict"] for r in urls.judge(df.filter("page_id = 11")).collect()} == {"allow"}
    assert urls.judge(df.limit(0)).count() == 0


def test_markov_ratio_tells_classes_apart():
    good = [f"http://a.example/ok/{i}" for i in range(200)]
    bad = [f"http://b.example/spam-{i}-win" for i in range(200)]
    model = urls.UrlModel(urls.MarkovModel(good[:150]), urls.MarkovModel(bad[:150]))
    model.calibrate(good[150:], bad[150:])
    assert all(model.difference(u) >= model.threshold for u in good) and all(model.difference(u) < model.threshold for u in bad)
    m = model.accepted
    assert abs(sum(m.probability("http:", c) for c in m.letters) + m.probability("http:", "\x7f") - 1) < 1e-9


@pytest.mark.parametrize("rows_a_task", [20_000, 40])
def test_every_url_is_learned_from(spark, monkeypatch, rows_a_task):
    """Counts, differences and threshold are those of all different URLs, however few a task gets."""
    monkeypatch.setattr(urls, "LEARN_ROWS", rows_a_task)
    rng = random.Random(4)
    some = [f"http://{rng.choice('abcé')}.{rng.choice(['org/es', 'org/fr', 'net/de', 'net/it'])}/{rng.choice(['win', 'ok', 'über', '😀'])}-{rng.randrange(99)}" for _ in range(600)]
    some += [*some[:50], *[some[0]] * 300, "http://x.org/es/" + "z" * 70, None, "", "no scheme", "x"]
    df = spark.createDataFrame(list(enumerate(some)), "page_id long, url string").repartition(5)
    different = df.filter("length(url) > 0").select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("back")).distinct()
    part = {(kind, back): [] for kind in ("allow", "block") for back in (False, True)}
    for r in different.collect():
        part[url_rule(r["url"])[3] or "allow", r["back"]].append(r["url"])
    want = urls.UrlModel(urls.MarkovModel(part["allow", False]), urls.MarkovModel(part["block", False]))
    want.calibrate(part["allow", True], part["block", True])
    made = urls.learn(urls.with_rule(df))
    assert made.accepted.totals == want.accepted.totals and made.rejected.totals == want.rejected.totals
    assert abs(made.threshold - want.threshold) < 1e-8
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert set(got) == set(range(len(some)))
    for i, u in enumerate(some):
        value = want.difference(u or "")
        assert abs(got[i]["difference"] - value) < 1e-8
        assert got[i]["verdict"] == (url_rule(u)[3] or ("block" if value < want.threshold else "allow"))


def test_grams_of_long_urls(monkeypatch):
    url = "http://é😀/" * 9
    whole = list(urls.grams_of(url))
    assert len(whole) == 1 and [g[-1] for g in whole[0]] == list(url) and {len(g) for g in whole[0]} == {urls.ORDER + 1}
    monkeypatch.setattr(urls, "PART", 16)
    assert [g for part in urls.grams_of(url) for g in part] == whole[0]


@pytest.mark.parametrize("rows_a_task", [20_000, 7])
def test_threshold_as_over_all_held_back(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(urls, "LEARN_ROWS", rows_a_task)
    rng = random.Random(6)
    for good, bad in ((rng.choices(range(-5, 30), k=80), rng.choices(range(-20, 9), k=50)), ([1, 3, 5], [2, 4, 6]), ([1], [2]), ([2, 2], [1]), ([3], [3]), ([1], [])):
        model = urls.UrlModel(urls.MarkovModel(()), urls.MarkovModel(()))
        monkeypatch.setattr(model, "difference", float)
        model.calibrate(good, bad)
        held = spark.createDataFrame([*((float(v), True) for v in good), *((float(v), False) for v in bad)], "difference double, accepted boolean")
        assert urls.calibrated(held) == model.threshold


def test_repeated_urls_are_learned_once(spark, monkeypatch):
    monkeypatch.setattr(urls, "LEARN_ROWS", 60)
    once = [(i, f"http://a.org/es/{i}" if i % 2 else f"http://b.net/fr/{i}") for i in range(100)]
    df = spark.createDataFrame(once, "page_id long, url string")
    many = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("_")
    models = [urls.learn(urls.with_rule(d)) for d in (df, many)]
    assert all(models) and models[0].threshold == models[1].threshold
    assert models[0].accepted.totals == models[1].accepted.totals and models[0].rejected.totals == models[1].rejected.totals


def brute(rows, k=5):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    for q, x in ok:
        if q % 50 == 0:
            found = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out[q] = [i for _, i in found]
    return out


def found(df):
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_odd_rows(spark):
    same = [1.0, 2.0, 0.0, 1.0]
    rows = [(i, same) for i in range(0, 120)] + [(200, [0.0, 1.0, 0.0, 0.0]), (201, None), (202, []), (203, [0.0] * 4), (204, [1.0, None, 0.0, 0.0])]
    rows += [(250, [float("nan")] * 4), (300, [1.0, 0.0]), (301, [0.0, 1.0]), (350, [1.0] * 3), (None, same), (205, [-1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    want = {q: ids for q, ids in brute(rows).items() if ids}
    assert found(df) == want and want[0] == [1, 2, 3, 4, 5] and want[300] == [301]
    assert found(df.limit(0)) == {}


def test_neighbours_of_repeated_ids(spark):
    same, near, far = [1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.1, 1.0], [0.0, 1.0, 0.0, 0.0]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def ranked(rows):
        return sorted({(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df(rows), F.col("vec_id") % 50 == 0).collect()})

    assert ranked([(50, same)] * 6 + [(60, same)]) == [(50, 1, 60)]
    twice = [(i, same) for i in (1, 2, 3, 50)] * 2 + [(70, near)]
    assert ranked(twice) == [(50, i + 1, x) for i, x in enumerate([1, 1, 2, 2, 3])]
    often = [(50, same)] * 9 + [(60, same)] * 9 + [(61, near)]
    assert ranked(often) == [(50, i + 1, 60) for i in range(5)]
    unlike = [(50, [1.0, 2.0, 0.01 * i, 1.0]) for i in range(9)] + [(60, far)]
    assert ranked(unlike) == [(50, 1, 60)]


def test_recall_over_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 256)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + 0.7 * rng.normal(size=32)).tolist()) for i in range(3000)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_chi_square():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
