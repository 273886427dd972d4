"""SimHash links, centroid rounds and resampling against brute force, and their answers to odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from panelwave.llm import centroids, resample, simhash
from panelwave.llm.textvec import Texts

WORDS = "alpha beta gamma delta of the and to house river stone ÄÖ été word seven light".split()
ODD = [
    (100, None), (101, ""), (102, "   \n\t "), (103, "one"), (104, "ONE"), (None, "no id at all"), (105, "x" * 30_000),
    (105, "x" * 30_000), (106, "Ünïcödé ▁   text \x00 end"), (107, "A b C d E f"), (108, "a B c D e F"), (None, "alone\tnobody else"),
]


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ly", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    for i in range(60, 95):  # near copies of long texts
        words = out[i % 9][1].split() * 6
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    out += [(i, "\n".join(out[3][1].upper().split(" "))) for i in range(95, 99)]
    out.append((99, prose(rng, 260_000)))  # longer than a slice
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    odd = [(i, t, "x", 1.5, 7, 3) for i, t in rows]
    names = "doc_id long, text string, score string, print double, rank int, weight int"
    return spark.createDataFrame(odd, names).repartition(3).cache()


# ---- 11 ------------------------------------------------------------------------------------------
def print_by_hand(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, ids, radius=3):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash_components(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [print_by_hand(t) for _, t in rows]
    comp = components_by_hand(prints, [d for d, _ in rows])
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, comp)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert len({c for c in comp}) < len(rows) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_bit_sliced_pairs():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(9)]
    prints = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(40)]
    ends = [1, 3, 90, 90 + 64, 300, len(prints)]
    stop = np.repeat(ends, np.diff([0, *ends]))
    for radius in (1, 2, 3, 5, 7):
        got = {(int(i), int(j)) for a, b in simhash.within(np.array(prints, np.uint64), stop, radius) for i, j in zip(a, b)}
        want = {(i, j) for i in range(len(prints)) for j in range(i + 1, stop[i]) if (prints[i] ^ prints[j]).bit_count() <= radius}
        assert got == want
    label = simhash.forest(6, iter([(np.array([4, 1]), np.array([5, 4])), (np.array([2]), np.array([3]))]))
    assert label.tolist() == [0, 1, 2, 2, 1, 1]


@pytest.mark.parametrize("bucket", [4, 512])
def test_crowded_buckets_are_dealt_again(spark, bucket):
    """Half of all prints share half of their bits, so buckets of four classes are dealt again several times."""
    rng = random.Random(4)
    crowd = [rng.getrandbits(24) << 8 | 0xABCD << 32 for _ in range(120)]
    prints = crowd + [c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for c in crowd[:60]] + [rng.getrandbits(64) for _ in range(60)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    got = {r.node: r.label for r in simhash.linked_prints(df, 3, bucket).collect()}
    want = components_by_hand(prints, [simhash._signed(p) for p in prints])
    assert [got.get(simhash._signed(p), simhash._signed(p)) for p in prints] == want


def test_radius_groups_cover_open_bits():
    mask = 0
    for _ in range(8):
        deeper = simhash.cut_open_bits(mask, 3)
        joined = 0
        for m in deeper:
            assert m & mask == mask and (m ^ mask) & joined == 0
            joined |= m ^ mask
        assert joined | mask == (1 << 64) - 1
        mask = deeper[-1]


# ---- 12 ------------------------------------------------------------------------------------------
def clusters_by_hand(vectors, k, rounds):
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min(range(len(cent)), key=lambda i: (far(v, cent[i]), i))
    for _ in range(rounds):
        own = [near(v) for _, v in vectors]
        for i in range(len(cent)):
            mine = [v for (_, v), o in zip(vectors, own) if o == i]
            if mine:
                cent[i] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(d, near(v), far(v, cent[near(v)])) for d, v in vectors], cent


def test_centroids_by_hand(spark):
    rng = random.Random(8)
    dims = 5
    raw = [(i, [rng.choice([-3.0, 0.0, 4.0]) + rng.gauss(0, 0.4) for _ in range(dims)]) for i in range(300)]
    raw += [(300 + i, [0.25] * dims) for i in range(80)]  # one hot vector, with ties
    raw += [(7, [1.0] * dims), (7, [2.0] * dims), (None, [0.5] * dims)]
    odd = [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims - 1) + [None]), (904, [1.0] * (dims - 1) + [math.nan]),
           (905, [math.inf] * dims), (906, [1.0] * (dims + 1))]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in raw + odd], "vec_id long, embedding array<float>, cluster int, upper double").repartition(3)
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in raw]
    for k in (1, 6):
        state, cent = centroids.cluster_vectors(table, dims=dims, clusters=k)
        want, want_cent = clusters_by_hand(whole, k, 3)
        got = state.collect()
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
        assert cent.tolist() == want_cent
    assert sum(r.scans for r in got) < 4 * len(got)  # bounds decided some


def test_centroids_of_few_vectors(spark):
    one = spark.createDataFrame([(5, [3e38, -3e38, 0.5])], "vec_id long, embedding array<float>")
    state, cent = centroids.cluster_vectors(one, dims=3)
    assert [(r.vec_id, r.cluster, r.distance) for r in state.collect()] == [(5, 0, 0)] and cent.tolist() == [[2**27, -(2**27), 32]]
    state, cent = centroids.cluster_vectors(one.limit(0), dims=3)
    assert state.count() == 0 and len(cent) == 0


def test_gain_bounds_hold_and_tighten():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(300):
        old, middle = rng.normal(size=8) * 10, rng.normal(size=8) * 10
        new = old + rng.normal(size=8) * rng.choice([0.1, 1, 5])
        radius = float(rng.choice([0.5, 3, 20]))
        bound = centroids.gained(old, new, middle, radius)
        x = rng.normal(size=(400, 8))
        x = middle + radius * x / np.linalg.norm(x, axis=1)[:, None] * rng.random((400, 1)) ** 0.1
        gain = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        drift = np.linalg.norm(new - old)
        assert gain.max() <= bound + 1e-9 and bound <= drift * (1 + 1e-9)
        tighter += bound < 0.9 * drift
    assert tighter > 100


def test_scans_only_where_bounds_meet(spark):
    """Separated groups: once centroids have settled, hardly any vector is scanned again."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 16)) * 20
    rows = [(i, (centres[i % 4] + rng.normal(size=16) * 0.2).tolist()) for i in range(800)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state, _ = centroids.cluster_vectors(table, dims=16, clusters=4, rounds=6)
    assert np.mean([r.scans for r in state.select("scans").collect()]) < 6


# ---- 13 ------------------------------------------------------------------------------------------
def words_of(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def feats_of(t, ngram=2):
    w = words_of(t)
    return [b" ".join(w[i : i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


def resample_by_hand(rows, target, ngram=2):
    k = 10_000
    own, goal = [0] * k, [0] * k
    found = [[zlib.crc32(f) % k for f in feats_of(t, ngram)] for _, t in rows]
    for b in (b for f in found for b in f):
        own[b] += 1
    for t in target:
        for f in feats_of(t, ngram):
            goal[zlib.crc32(f) % k] += 1
    s, t = sum(own), sum(goal)
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + k) / ((own[b] + 1) * (t + k)))) for b in range(k)]
    out = []
    for (d, text), f in zip(rows, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[3], r[2]))
    drawn = [(*r, i + 1) for i, r in enumerate(fit[: 25 * len(fit) // 100])]
    rest = [(*r, None) for r in fit[25 * len(fit) // 100 :] + [r for r in out if r[1] < 20]]
    return sorted(drawn + rest, key=str)


@pytest.mark.parametrize("ngram", [2, 3])
def test_resample_by_hand(spark, docs, rows, ngram):
    target = [rows[3][1], rows[4][1], None, "", "light of the river"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = resample.resample(docs, bench, ngram=ngram)
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == resample_by_hand(rows, target, ngram)
    assert resample.resample(docs.limit(0), bench).count() == 0
    none = resample.resample(docs, bench.limit(0)).collect()
    assert sorted((tuple(r) for r in none), key=str) == resample_by_hand(rows, [])


def test_crc_of_runs_by_shift(rows):
    texts = Texts(pa.array([t for _, t in rows[:60]] + ["w" * 5000 + " é " + "v" * 70_000, None, "a"]))
    runs = resample.Runs(texts)
    by_hand = [words_of(t) for t in [t for _, t in rows[:60]] + ["w" * 5000 + " é " + "v" * 70_000, None, "a"]]
    for n in (1, 2, 3, 7):
        crc, own = runs.crcs(n)
        want = [(zlib.crc32(b" ".join(w[i : i + n])), k) for k, w in enumerate(by_hand) for i in range(len(w) - n + 1)]
        assert list(zip(crc.tolist(), own.tolist())) == want


def test_ranks_of_one_key_are_split(spark):
    rows = spark.range(4000).selectExpr("7 as doc_id", "1 as score", "id % 3 as other").repartition(8)
    from pyspark.sql import functions as F

    got = resample.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc()])
    assert sorted(r.rank for r in got.collect()) == list(range(1, 4001))
