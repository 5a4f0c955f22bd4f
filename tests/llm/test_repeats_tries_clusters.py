"""Operators 11 to 13 against plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paralex.llm import anchors, centroids, merging, patricia, prefixes, repeats


def plain_repeats(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        hit = bytearray(len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                hit[p : p + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(hit[a] and (a == 0 or not hit[a - 1]) for a in range(len(b)))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def texts_with_repeats():
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(2, 7))) for _ in range(n))
    shared = [word(60) for _ in range(4)]
    out = [word(rng.randint(0, 50)) + rng.choice(shared)[rng.randint(0, 40) :] + word(rng.randint(0, 30)) for _ in range(40)]
    out += [shared[0]] * 5 + [shared[1][:150] + "X" + shared[1][151:] for _ in range(3)]
    out += [None, "", "ab", "z" * 700, "z" * 199, "ab" * 300, word(10) * 9, shared[2][:200], shared[2][:199] + "?"]
    return [(i % 60 if i % 11 else None, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("group,sample", [(4_096, 1 / 64), (2, 1.0)])
def test_repeats(spark, monkeypatch, group, sample):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    rows = texts_with_repeats()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, k1 int, `a.b` int").repartition(3)
    for length in (200, 64):
        got = repeats.without_repeats(docs, length=length)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.select(*names).collect()), key=str) == plain_repeats(rows, length)
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(docs, length=10)


def test_anchors_are_leftmost_least_cores(monkeypatch):
    monkeypatch.setattr(anchors, "TILE", 100)
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab ", k=3_000)), np.uint8)
    cores = anchors.core_hashes(data, np.arange(len(data) - anchors.CORE + 1)) >> np.uint64(32)
    got = anchors.anchors(data, 200)
    assert len(got) == 2_801 and all(got[p] == p + int(cores[p : p + 169].argmin()) for p in range(len(got)))
    monkeypatch.setattr(anchors, "SLICE", 700)
    starts, ends = np.array([0, 100, 900]), np.array([100, 900, 3_000])
    covered = sorted(p for part in anchors.segments(data, starts, ends, 200) for a, b in zip(part[1], part[2]) for p in range(a, b + 1))
    assert covered == [*range(100, 701), *range(900, 2_801)]


def test_merge_never_compares_known_prefixes(monkeypatch):
    rng = random.Random(2)
    runs = [sorted((bytes(rng.choices(b"ab", k=rng.randint(0, 60))), b"%d" % i) for i in range(rng.randint(0, 9))) for _ in range(7)]
    calls = []
    plain = merging.common
    monkeypatch.setattr(merging, "common", lambda x, y, known=0: calls.append((x[:known], y[:known])) or plain(x, y, known))
    got = list(merging.merge([merging.write_run(r) for r in runs]))
    assert [g[1] for g in got] == sorted(x for r in runs for x, _ in r) and sorted(g[1:] for g in got) == sorted(x for r in runs for x in r)
    assert all(got[i][0] == plain(got[i - 1][1], got[i][1]) for i in range(1, len(got)))
    assert all(x == y for x, y in calls)


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for v in convs.values():
        v.sort(key=lambda x: x[:2])
    made = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = [x[2:] for x in convs.get(c - c % 5, [])[:h]] + [x[2:] for x in v[h:]]
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in sorted(members, key=len, reverse=True):
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] += not children[node]
        if node:
            saved[node[:-1]] += saved[node]
            leaves[node[:-1]] += leaves[node]
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(node))))
        above = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), above, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,ends", [(64, 4_096), (2, 3)])
def test_trie(spark, monkeypatch, size, ends):
    monkeypatch.setattr(prefixes, "ENDS", ends)
    rng = random.Random(5)
    rows = [(c, t or None, rng.choice("ua"), rng.choice(["a", "bé", "", None])) for c in rng.sample(range(90), 60) for t in range(rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += [(c, t, "u", "a") for c in range(100, 130) for t in range(12)] + [(131, 1, None, "x"), (None, 1, "u", "lost")]
    rows += [(10_000, t, "u", f"{t % 7}") for t in range(300)]  # most turns of the table
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several stretches, and a conversation over them
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, c int").repartition(3)
        assert sorted((tuple(r) for r in prefixes.trie(df, size).collect()), key=str) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_an_empty_table(spark):
    assert prefixes.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_trees_of_stretches_add_up():
    rng = random.Random(8)
    keys = sorted(b"".join(bytes([rng.choice(b"ab")]) * patricia.STEP for _ in range(rng.randint(0, 7))) for _ in range(80))
    every = [patricia.Sequence((0, 0), k, [1] * (len(k) // patricia.STEP), i) for i, k in enumerate(keys)]

    def nodes(parts):
        stretches = []
        for part in parts:
            b = patricia.Builder()
            heads = {n.depth for s in part for n in b.add(s) if n.point.head}
            last = frozenset(p.depth for p in b.open)
            heads |= {n.depth for n in b.end() if n.point.head}
            stretches.append(patricia.Stretch(((0, 0), part[0].key), ((0, 0), part[-1].key), frozenset(heads), last))
        out = {}
        for part, known in zip(parts, patricia.points_between(stretches)):
            b = patricia.Builder(*known)
            for n in [n for s in part for n in b.add(s)] + list(b.end()):
                p, key = n.point, n.of.key[: n.depth * patricia.STEP]
                old = out.get(key, (n.parent_depth, 0, p.low, 0, 0, 0))
                assert old[0] == n.parent_depth
                out[key] = (old[0], old[1] + p.n, min(old[2], p.low), old[3] + p.saved, old[4] + p.leaves, old[5] + p.children)
        return out

    whole = nodes([every])
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, 80), rng.randint(1, 12)))
        assert nodes([every[a:b] for a, b in zip([0, *cuts], [*cuts, 80])]) == whole


def plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept], np.int64)
    first = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))[:k]
    c = x[first].copy()
    for _ in range(rounds):
        at = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        for n in set(at.tolist()):
            c[n] = [int(s) // int((at == n).sum()) for s in x[at == n].sum(0)]
    d = ((x[:, None] - c) ** 2).sum(-1)
    at, far = d.argmin(1), d.min(1)
    digest = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((kept[j][0], int(at[j]), int(far[j]), int(far[at == at[j]].sum()), int(far.sum()), digest[at[j]]) for j in range(len(kept))), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, `cluster` int").repartition(3)


def clustered(rows_of):
    return sorted((tuple(r) for r in rows_of.collect()), key=str)


@pytest.mark.parametrize("block", [4_096, 40])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 3, (5, 64))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 5] + rng.normal(0, 0.1 if i % 5 else 2, 64)]) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1])]  # a hot vector, and a repeated row
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [float("nan")] * 64), (504, [None] + [1.0] * 63), (505, [float("inf")] * 64), (506, [0.0] * 64)]
    assert clustered(centroids.cluster(vectors(spark, rows))) == plain_clusters(rows, 8, 10)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(centroids.cluster(vectors(spark, rows))) == plain_clusters(rows, 8, 10)
    assert centroids.cluster(vectors(spark, rows).limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [1e9] * 64)])).collect()


def test_filtering_prunes_and_stays_exact():
    rng = np.random.default_rng(6)
    middles = rng.integers(-9_000, 9_000, (20, 8))
    points = middles[rng.integers(0, 20, 3_000)] + rng.integers(-50, 50, (3_000, 8))
    tree, order = centroids.build(points)
    assert (tree.points == points[order]).all()
    found, whole = np.full(3_000, -1), 0
    for centre, node, start, end in centroids.filtered(tree, middles):
        found[start:end] = centre
        whole += end - start if node >= 0 else 0
        assert node < 0 or (tree.sums[node] == tree.points[start:end].sum(0)).all()
    assert (found == ((tree.points[:, None] - middles) ** 2).sum(-1).argmin(1)).all() and whole > 2_700
