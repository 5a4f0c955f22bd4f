"""Tokenising, packing and token files."""

import functools
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from paralex.llm import bpe, hf, packing, pretokens, queries, sstable  # noqa: E402

ALPHABET = ["a", "b", " ", "'", "s", "ll", "'re", "\n", "\t", "\x1c", "\x85", "é", "1", "²", "Ⅷ", ".", "中", "\U0001f600", " 's", "  ", "́"]
HARD = ["", " ", "  ", "a  b", "x's 've'll", "' s", "''s", "<|endoftext|> a", "ab" * 5000, "\n" * 999, "é" * 3000, None]


def hard_texts(n=400):
    rng = random.Random(1)
    return HARD + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = hard_texts()
    return spark.createDataFrame([(i, t, "n_tokens") for i, t in enumerate(texts)] + [(None, "a b", "x"), (3, "a  b", "x")], "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bulk_split_is_the_pattern():
    assert pretokens.PATTERN == public.PATTERN
    texts = [t or "" for t in hard_texts(3000)]
    find, at = regex.compile(public.PATTERN).findall, 0
    for words, ends in pretokens.split_texts(texts):
        start = 0
        for end in ends:
            assert words[start:end] == find(texts[at])
            start, at = end, at + 1
    assert at == len(texts)


def test_merge_of_any_rank_table():
    """Against a plain search for the lowest pair, with ranks that aren't a trained order."""
    rng = random.Random(2)
    pieces = {bytes([c]) for c in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 4))) for _ in range(60)}
    ranks = {p: r for r, p in enumerate(rng.sample(sorted(pieces), len(pieces)))}
    for _ in range(300):
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
        parts = [word] if word in ranks else [bytes([c]) for c in word]
        while True:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(word, ranks) == [ranks[p] for p in parts]


def test_encode_decode_as_the_library(docs, reference):
    rows = docs.select("doc_id", "text").collect()
    got = bpe.round_trip_digests(docs).collect()
    want = sorted(
        (str(r["doc_id"]), hashlib.sha256(np.array(reference.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        for r in rows
    )
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    encoded = bpe.encode(docs)
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded).filter("doc_id = 4").collect()}
    assert decoded == {4: b"x's 've'll"}
    assert bpe.round_trip_digests(docs.limit(0)).count() == 0


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_library_encoder():
    texts = [t or "" for t in hard_texts(200)]
    got = [np.frombuffer(x, "<u4").tolist() for x in hf.LibraryEncoder().encode(texts)]
    assert got == [library_ids(t) for t in texts]


def test_cache_forgets_without_harm():
    cache = pretokens.PieceCache(lambda ws: [w.encode() for w in ws], limit=10)
    words = [str(i % 37) for i in range(500)]
    for i in range(0, 500, 20):
        assert cache.ids(words[i : i + 20]) == [w.encode() for w in words[i : i + 20]]
    assert len(cache.new) + len(cache.old) <= 60


@pytest.mark.parametrize("words", [1, 50, 1 << 12])
def test_table_of_matches_changes_nothing(words):
    """Places that many matches share, lengths on both sides of the table's longest, NUL
    characters, matches of many ids, and every width of UTF-8."""
    rng = random.Random(words)
    kinds = ["a" * n for n in range(1, 20)] + ["a\0", "a\0\0", "\0", "é" * 7, "é" * 8, "日本語日本", "日本語日本語", "😀😀😀", "😀" * 4, "1234", "x", " x", "!" * 9]
    texts = [" ".join(rng.choices(kinds, k=rng.randint(0, 12))) for _ in range(400)] + ["", " ", "\n"]
    asked = []

    def ids_of(found):
        asked.extend(found)
        return [np.array([*w.encode(), len(w)], "<u4")[-(1 + len(w) % 6) :].tobytes() for w in found]

    coder = pretokens.PieceEncoder(ids_of, words)
    find = regex.compile(public.PATTERN).findall
    for _ in range(2):
        for at in range(0, len(texts), 20):
            some = texts[at : at + 20]
            want = [b"".join(ids_of(find(t))) for t in some]
            asked.clear()
            assert list(coder.encode(some)) == want
    if words > len(kinds) * 8:
        assert len(asked) <= 2  # remembered


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {2048: 7}, {1: 5000}, {2047: 3, 1: 5}, {1500: 4, 600: 9, 548: 2, 3: 1000}])
def test_plan_places_all(histogram):
    patterns = packing.plan(histogram)
    placed = {}
    for p in patterns:
        assert sum(n * k for n, k in p.parts) <= 2048
        for n, k in p.parts:
            placed[n] = placed.get(n, 0) + k * p.count
    assert placed == histogram


def test_packing(docs):
    out = packing.pack_documents(docs).toPandas()
    assert len(set(zip(out.sequence_id, out.offset))) == len(out)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(np.array([*library_ids(r["text"]), 1], "<u4").tobytes())) for r in docs.collect() if len(r["text"] or "") < 900)
    whole = out[out.doc_tokens <= 2048]
    got = sorted(zip(whole.doc_id.fillna(-1).astype(int), whole.ids_crc32))
    assert set(want) <= set(got)
    full = packing.sequences(packing.pack_documents(docs.filter("doc_id < 30")), pad_id=7).collect()
    assert {len(r["ids"]) for r in full} <= {2 ** i for i in range(12)} | {2048}
    assert packing.pack_documents(docs.limit(0), with_ids=False).count() == 0


def test_shard_files(spark, docs):
    manifest = sstable.write_shards(docs, tasks=3)
    got = sorted(sstable.read_shards(spark, manifest).collect(), key=lambda r: r["start"])
    at = 0
    keys = []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        keys.append(sstable.key_of(r["doc_id"]))
    assert keys == sorted(keys) and len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(zlib.crc32(np.array([*library_ids(r["text"]), 2], "<u4").tobytes()))
    assert all(r["ids_crc32"] in texts[r["doc_id"]] for r in got)
    assert sstable.read_shards(spark, sstable.write_shards(docs.limit(0), tasks=2)).count() == 0


def test_shards_begin_anew_when_full(spark, docs):
    """One task, many records: files follow the data, not the session's partitions."""
    got = sstable.read_shards(spark, sstable.write_shards(docs, tasks=1)).orderBy("start").collect()
    manifest = sstable.write_shards(docs, tasks=1, shard_records=7)
    assert [s.records for s in manifest[:-1]] == [7] * (len(manifest) - 1) and len(manifest) == -(-len(got) // 7)
    assert sstable.read_shards(spark, manifest).orderBy("start").collect() == got
    by_size = sstable.write_shards(docs, tasks=1, shard_bytes=3_000)
    assert len(by_size) > 1 and sstable.read_shards(spark, by_size).orderBy("start").collect() == got


def test_lookup_and_damage():
    sink = io.BytesIO()
    writer = sstable.ShardWriter(sink, 2, block_bytes=200)
    ids = [None, -5, *range(0, 900, 3), 10**12]
    for i in ids:
        writer.add(sstable.key_of(i), np.arange(3) + (i or 0) % 100)
    writer.close()
    reader = sstable.ShardReader(sink)
    assert len(reader.places) > 10 and [sstable.doc_of(k) for k, _ in reader] == ids
    assert reader.get(300)[0].tolist() == [0, 1, 2] and reader.get(None)[0].tolist() == [0, 1, 2]
    assert reader.get(301) == [] and reader.get(10**15) == []
    assert sum(reader.may_hold(sstable.key_of(i)) for i in range(1, 900, 3)) < 30
    data = bytearray(sink.getvalue())
    data[5] ^= 1
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(bytes(data))))


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert F is not None


def test_pipeline_packs_ids(spark):
    texts = ["one two three " * n for n in (1, 5, 40, 900, 2500)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    want = {(r["doc_id"], r["start"]): r["ids"] for r in packing.pieces(docs).collect()}
    assert {(r["doc_id"], r["start"]): r["ids"] for r in rows} == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        whole[r["sequence_id"]] = whole.get(r["sequence_id"], b"") + r["ids"]
    for r in rows:
        data = whole[r["sequence_id"]]
        n = len(data) // 4
        data += bytes(4 * (2048 - n)) if n & (n - 1) else b""
        assert (r["sequence_length"], r["sequence_crc32"]) == (len(data) // 4, zlib.crc32(data))
