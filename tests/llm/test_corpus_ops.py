"""Corpus operators against brute force on small tables, and their answers to odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwave.llm import coversort, decontaminate, fmindex, hashed, lm, minhash, orderhash, pieces, quality, quoting
from panelwave.llm import suffixdedup, toxicity, warc
from panelwave.llm.components import components
from panelwave.llm.textvec import ALNUM, NOT_SPACE, Texts

WORDS = "alpha beta gamma delta of the and to house river stone ÄÖ été word seven light".split()
ODD = [
    (100, None), (101, ""), (102, "   \n\t "), (103, "one"), (104, "one"), (None, "no id at all"), (105, "x" * 30_000),
    (105, "x" * 30_000), (106, "Ünïcödé ▁   text \x00 end"), (107, "A b C d E f"), (108, "a B c D e F"),
]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ly", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(1, 90))) for i in range(60)]
    for i in range(60, 90):  # near copies, shared passages, copies
        words = out[i % 20][1].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    shared = prose(rng, 60)
    out += [(i, prose(rng, 10) + " " + shared + " " + prose(rng, 10)) for i in range(90, 96)]
    out += [(i, out[3][1].upper()) for i in range(96, 99)]
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns with names that operators use themselves
    odd = [(i, t, "x", 1.5, 7) for i, t in rows]
    return spark.createDataFrame(odd, "doc_id long, text string, score string, seq double, n_words int").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def lower(t: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def split(t: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(t))


def alnum(t: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


# ---- helpers -------------------------------------------------------------------------------------
def test_words_and_hashes(rows):
    t = Texts(pa.array([x for _, x in rows]))
    for table, by_hand in ((NOT_SPACE, split), (ALNUM, alnum)):
        starts, ends, owner = t.words(table)
        want = [(k, w) for k, (_, x) in enumerate(rows) for w in by_hand(x)]
        assert [(int(k), t.data[a:b].tobytes()) for k, a, b in zip(owner, starts, ends)] == want
        by_word = defaultdict(set)
        for h, (_, w) in zip(t.hashes(starts, ends).tolist(), want):
            by_word[w].add(h)
        assert all(len(v) == 1 for v in by_word.values())
        assert len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    pairs += [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


# ---- 1 -------------------------------------------------------------------------------------------
def near_by_hand(rows):
    def sets(t):
        w = split(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s[i]), least.get(root(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_minhash_components(docs, rows, nothing):
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(nothing).count() == 0


def test_minhash_large_and_small_classes(docs, rows, spark, monkeypatch):
    """Members of a class that holds most rows, of small ones, and rows without words take different ways."""
    monkeypatch.setattr(minhash, "LARGE", 3)
    copies = [(1000 + k, "one two three four five six seven") for k in range(len(rows))]
    every = rows + copies + [(5000, None), (None, ""), (None, " ")]
    got = minhash.near_duplicates(spark.createDataFrame(every, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_by_hand(every)


def test_minhash_mixed_buckets(spark, monkeypatch):
    """Chains of near copies, which no single leader links, and buckets larger than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(14):
            base = list(base)
            at = rng.randrange(120)
            base[at : at + 2] = [f"n{family}{k}a", f"n{family}{k}b"]
            rows.append((len(rows), " ".join(base)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == near_by_hand(rows)


def test_estimate_follows_similarity(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = base[:300] + [f"v{i}" for i in range(100)]
    sig = minhash.signatures(spark.createDataFrame([(0, " ".join(base)), (1, " ".join(other))], "doc_id long, text string"), ["doc_id"])
    low = [r.low for r in sig.orderBy("doc_id").collect()]
    df = spark.createDataFrame([(low[0], low[1])], "a array<long>, b array<long>")
    got = df.select(minhash.estimate(F.col("a"), F.col("b")).alias("e")).head().e
    assert abs(got - 296 / (396 * 2 - 296)) < 0.2


# ---- 2 -------------------------------------------------------------------------------------------
def repeats_by_hand(rows):
    unique = sorted({(d if d is not None else math.inf, (t or "").encode()) for d, t in rows})
    seen, cut = set(), {}
    for key in unique:
        data = key[1]
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        cut[key] = gone
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = cut[(d if d is not None else math.inf, data)]
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out.append((d, len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2048, 0])
def test_suffix_dedup(docs, rows, nothing, hot):
    got = suffixdedup.remove_repeats(docs, carry=["doc_id"], hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == repeats_by_hand(rows)
    assert suffixdedup.remove_repeats(nothing, carry=["doc_id"]).count() == 0


def test_cover_sorts_suffixes():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 4, 200):
        parts = [rng.integers(0, sigma, n).astype(np.uint8) for n in (1, 7, 8, 130, 260, 130)]
        parts.append(parts[3].copy())
        text = np.concatenate(parts)
        stop = np.cumsum([len(p) for p in parts])
        ends = np.repeat(stop, [len(p) for p in parts])
        whole = text.tobytes()
        suffix = [whole[i : min(int(ends[i]), i + 100)] for i in range(len(text))]
        got = np.concatenate(list(coversort.sorted_suffixes(text, ends, np.arange(len(text)), 100)))
        assert [suffix[i] for i in got] == sorted(suffix)
        full = np.flatnonzero(ends - np.arange(len(text)) >= 100)
        for order, run in coversort.repeats(text, ends, full, 100):
            groups = defaultdict(set)
            for i, r in zip(order.tolist(), run.tolist()):
                groups[r].add(suffix[i])
            assert all(len(g) == 1 for g in groups.values())
            assert len({next(iter(g)) for g in groups.values()}) == len(groups)


# ---- 3 -------------------------------------------------------------------------------------------
def test_language_model(spark, docs, rows, nothing):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out, m = lm.score(docs, ~held, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for t in train:
        seq = [*split(t), None]
        one.update(seq)
        two.update(zip([None, *seq], seq))
    n, v = sum(one.values()), len(one)
    assert (m.n, m.v) == (n, v) and np.allclose(m.weights.sum(axis=1), 1)
    want = []
    for d, t in rows:
        base = total = 0.0
        seq = [*split(t), None]
        for a, b in zip([None, *seq], seq):
            c = one[a]
            w = m.weights[math.floor(math.log2(c)) + 1 if c else 0]
            total += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + w[2] * (two[a, b] / c if c else 0))
            base += math.log10((one[b] + 0.5) / (n + 0.5 * (v + 1)))
        want.append((d, len(seq), sum(one[b] > 0 for b in seq), round(base, 6), round(total, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty, m = lm.score(nothing, ~held, held)
    assert empty.count() == 0 and m.n == 0


def test_weights_maximise_likelihood():
    rng = np.random.default_rng(4)
    cells = np.column_stack([np.full(50, 3), rng.integers(1, 90, 50), np.full(50, 1e-4), rng.random(50) / 9, rng.random(50) / 2])
    w = lm.learn_weights(cells)[3]

    def gain(x):
        return (cells[:, 1] * np.log(cells[:, 2:] @ x)).sum()

    for _ in range(200):
        other = np.abs(w + rng.normal(0, 0.02, 3)) + 1e-6
        assert gain(other / other.sum()) <= gain(w) + 1e-6


# ---- 4 -------------------------------------------------------------------------------------------
def hits_by_hand(rows, bench):
    wins = defaultdict(set)
    for i, t in bench:
        w = alnum(t)
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            wins[tuple(w[k : k + 13])].add(str(i))
    out = []
    for d, t in rows:
        w = alnum(t)
        hit, items = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (found := wins.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    items |= found
        out.append((d, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, rows, nothing, part_bytes):
    bench = [(1, rows[2][1]), (2, rows[3][1]), (20, rows[3][1]), (3, None), (4, "one"), (5, " ".join(rows[90][1].split()[20:50])),
             (None, rows[5][1]), (6, "a b c d e f"), (7, "")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.decontaminate(docs, table, part_bytes=part_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str) == hits_by_hand(rows, bench)
    text = dict(rows)
    for r in got:
        if r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert sum(len(alnum(data[s.start : s.end].decode())) for s in r.spans) == r.n_hit
    assert decontaminate.decontaminate(nothing, table).count() == 0
    assert not decontaminate.decontaminate(docs, table.limit(0)).filter("contaminated").count()


def test_fm_index():
    rng = np.random.default_rng(3)
    runs = [rng.integers(1, 4, n) for n in (5, 40, 200, 40)] + [np.ones(60, np.int64)]
    runs.append(runs[2].copy())
    symbols = np.concatenate([x for r in runs for x in ([0], r)] + [[0]]).astype(np.int64)
    index = fmindex.FMIndex(symbols, 4, sample=5)
    for length in (1, 3, 13):
        for _ in range(20):
            pattern = rng.integers(1, 4, length) if length < 13 else runs[2][7:20]
            lo, hi = index.search(np.array([pattern]), np.array([length]))
            want = [i for i in range(len(symbols) - length + 1) if (symbols[i : i + length] == pattern).all()]
            assert sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0])))) == want


# ---- 5 -------------------------------------------------------------------------------------------
def test_pieces_equal_the_library(docs, rows, nothing):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode(docs, path, carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(r.round_trip == ("▁" not in (r.text or "")) for r in got)
    assert all(r.ids == library.encode(r.text or "") and r.n_pieces == len(r.ids) for r in got)
    assert pieces.encode(nothing, path).count() == 0
    odd = ["  two  spaces ", " ", "▁▁x", "<s> </s> <0x41>", "\n\n", "日本語 テキスト 🙂", "of the " * 500]
    encoder = pieces.Encoder(pieces.load(path))
    offsets, ids = encoder.encode(odd)
    for t, a, b in zip(odd, offsets, offsets[1:]):
        assert ids[a:b].tolist() == library.encode(t)
    bounds, data = pieces.decode(encoder.model, offsets, ids)
    assert [data[a:b].decode() for a, b in zip(bounds, bounds[1:])] == odd[:2] + ["  x"] + odd[3:]


def test_unigram_paths():
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc"]
    scores = [0, -2, -2.1, -2.2, -2.3, -3.1, -2.9, -3.0, -9.0]
    m = pieces.Model(names, scores, [2] + [1] * 8)
    rng = random.Random(8)

    def best(word):
        states = [(0.0, [])]
        for end in range(1, len(word) + 1):
            states.append(max((
                (states[s][0] + scores[names.index(word[s:end])], states[s][1] + [names.index(word[s:end])])
                for s in range(end) if word[s:end] in names[1:]), key=lambda x: x[0]))
        return states[-1]

    encoder = pieces.Encoder(m)
    for _ in range(60):
        text = "".join(rng.choice("abc ") for _ in range(12))
        _, ids = encoder.encode([text])
        words = encoder.find("▁" + text.replace(" ", "▁"))
        assert math.isclose(sum(scores[i] for i in ids), sum(best(w)[0] for w in words))


# ---- 6 -------------------------------------------------------------------------------------------
def fingerprints_by_hand(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: r.f for r in df.select("i", orderhash.as_text(orderhash.fingerprint(F.col("t"))).alias("f")).collect()}


def test_order_minhash(spark, docs, rows, nothing):
    got = orderhash.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    # rows of one id follow one another by hash; compare the part of the table with distinct ids
    chosen = [(d, t or "") for d, t in rows if d is not None and d != 105]
    plain = spark.createDataFrame(chosen, "doc_id long, text string")
    got = {r.doc_id: r for r in orderhash.fingerprint_edits(plain).collect()}
    order = sorted(chosen, reverse=True)
    texts, edited = dict(chosen), {}
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited[d] = t[: len(t) - half] + nxt[:half]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited[d].encode()).hexdigest()
    ids = list(texts)
    prints = fingerprints_by_hand(spark, [texts[d] for d in ids] + [edited[d] for d in ids])
    for k, d in enumerate(ids):
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (prints[k], prints[len(ids) + k])
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    assert got[103].fingerprint == got[104].fingerprint
    assert orderhash.fingerprint_edits(nothing).count() == 0


def test_order_minhash_chunks(spark, rows, monkeypatch):
    """The same result whatever the chunks."""
    df = spark.createDataFrame([(3 * i, f"text {i} " * (i % 7)) for i in range(57)], "doc_id long, text string")
    for chunk in (5, 1000):
        got = {r.doc_id: r.next_row.text for r in orderhash.with_next(df, ["text"], chunk=chunk).collect()}
        assert got == {3 * i: f"text {(i - 1) % 57} " * ((i - 1) % 57 % 7) for i in range(57)}


def test_order_matters(spark):
    rng = random.Random(2)
    a = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    moved = [x for i in range(0, 300, 6) for x in a[i + 3 : i + 6] + a[i : i + 3]]
    swapped = a[150:] + a[:150]
    edited = a[:140] + ["new"] + a[141:]
    p = fingerprints_by_hand(spark, [" ".join(x) for x in (a, moved, swapped, edited)])
    same = lambda x, y: np.mean([x[i : i + 8] == y[i : i + 8] for i in range(0, len(x), 8)])
    assert same(p[0], p[3]) > 0.85 > same(p[0], p[2]) > same(p[0], p[1])  # swapping halves turns the order of many pairs


def order_minhash_share(a, b, n_slots=1500):
    """Share of equal slots of order MinHash by definition: the two smallest 3-mers of each slot's own order, in text order."""
    def numbered(text):
        words, seen, out = text.split(), {}, []
        for i in range(len(words) - 2):
            g = " ".join(words[i : i + 3])
            seen[g] = seen.get(g, -1) + 1
            out.append((g, seen[g]))
        return out

    x, y = numbered(a), numbered(b)
    every = sorted(set(x) | set(y))
    rng, equal = np.random.default_rng(5), 0
    for _ in range(n_slots):
        rank = dict(zip(every, rng.permutation(len(every)), strict=True))
        u, v = (sorted(sorted(range(len(t)), key=lambda i: rank[t[i]])[:2]) for t in (x, y))  # noqa: B023
        equal += [x[i] for i in u] == [y[i] for i in v]
    return equal / n_slots


@pytest.mark.parametrize("words", [20, 40, 100])
def test_order_matters_in_short_texts(spark, words):
    rng, got, wanted = random.Random(words), [], []
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(words)] for _ in range(24)]
    swapped = [a[words // 2 :] + a[: words // 2] for a in texts]
    p = fingerprints_by_hand(spark, [" ".join(x) for x in texts + swapped])
    for k, (a, b) in enumerate(zip(texts, swapped, strict=True)):
        got.append(np.mean([p[k][i : i + 8] == p[24 + k][i : i + 8] for i in range(0, 512, 8)]))
        if k < 2:
            wanted.append(order_minhash_share(" ".join(a), " ".join(b)))
    assert abs(np.mean(got) - np.mean(wanted)) < 0.05


# ---- 7 -------------------------------------------------------------------------------------------
def test_label_model_finds_accuracies():
    rng = np.random.default_rng(6)
    y = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.7, 0.65])
    v = np.where(rng.random((len(y), 4)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    v[rng.random(v.shape) < 0.2] = 0
    rows, count = np.unique(v, axis=0, return_counts=True)
    m = quality.fit_labels(rows, count.astype(float))
    got = m.chance[:, 1, 2] / (1 - m.chance[:, 1, 1])
    assert abs(m.prior - 0.7) < 0.05 and np.abs(got - right).max() < 0.06
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.88


def test_quality(spark, docs, rows, nothing):
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert all(len(r.votes) == len(quality.LABELLERS) for r in got)
    assert quality.score(nothing, model).count() == 0
    assert quality.score(docs, quality.fit(nothing)).count() == len(rows)


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    got = quality.score(table, quality.fit(table)).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.9 and (bad.predicted == 0).mean() > 0.5


# ---- 8 -------------------------------------------------------------------------------------------
def test_quotation_links(spark):
    a, b = "Where is the river?\n\nAnd the house?", "The river is far.\nThe house is near."
    rows = [
        (1, 0, "user", a),
        (1, 1, "assistant", "On Monday someone wrote:\n> Where is the RIVER?\n>\n> And the house?\n" + b),
        (1, 2, "user", "> The house is   near.\nAre you sure?"),
        (1, 3, "user", ">> And the house?\n> The river is far.\n> Unknown words\nHow far?"),
        (1, 4, "user", "> Are you sure?\nYes."),
        (1, 5, "user", None), (1, 6, "user", ""), (1, None, "user", "no turn"), (None, 0, "user", "> Where is the river?\nno id"),
        (2, 0, "user", "Same words"), (2, 300, "user", "Same words"), (2, 700, "user", "> same words\nlate"), (2, 700, "user", "> same words\nlate"),
        (3, 0, "user", "> Same words\nother conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x"))
    got = {(r.conv_id, r.turn, r.body): r for r in quoting.link_quotes(df).collect()}
    one = {k[1]: r for k, r in got.items() if k[0] == 1}
    assert one[1].body == b and one[1].reply_to == 0 and one[1].n_quotes == 1
    assert one[2].body == "Are you sure?" and one[2].reply_to == 1 and one[2].root == 0 and one[2].depth == 2
    assert [(q.level, q.turn) for q in one[3].quotes] == [(1, 1), (2, 0)] and one[3].reply_to == 1
    assert one[4].reply_to == 2 and one[4].depth == 3 and one[4].root == 0
    assert one[5].body == one[6].body == "" and one[5].root == 5 and one[None].reply_to is None
    assert got[(2, 700, "late")].reply_to == 300 and got[(3, 0, "other conversation")].reply_to is None
    assert got[(None, 0, "no id")].reply_to is None
    assert sorted(r.position for k, r in got.items() if k[0] == 1) == list(range(1, 9))
    assert all(one[r.reply_to].position < r.position for r in one.values() if r.reply_to is not None)
    assert len(quoting.link_quotes(df).collect()) == len(rows)
    assert quoting.link_quotes(df.limit(0)).count() == 0
    plain = quoting.link_quotes(df.filter("text not like '%>%'")).collect()
    assert all(r.reply_to is None and r.root == r.turn for r in plain)


# ---- 9 -------------------------------------------------------------------------------------------
def test_toxicity_is_fitted_without_texts_on_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got, whole = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: got.append(df.schema) or whole(df))
    model = toxicity.fit(docs, labels)
    assert len(model.weights) and got
    assert "string" not in " ".join(s.simpleString() for s in got)


def test_toxicity_learns_and_locates(spark, nothing):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        sentences = [prose(rng, 8) + "." for _ in range(rng.randint(2, 12))]
        bad = rng.random() < 0.3
        if bad:
            sentences.insert(rng.randrange(len(sentences)), "you are a vile troll indeed.")
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "vile troll"), (902, "!!! ...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels + [(901, None), (3, 0)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    texts = dict(rows)
    for i in held:
        for s in got[i].sentences if truth[i] and got[i].predicted else []:
            assert "vile troll" in texts[i].encode()[s.start : s.end].decode()
    assert got[900].score == got[901].score == got[902].score == 0
    assert toxicity.score(df.limit(0), model).count() == 0
    blank = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(df, blank).collect())


def test_noisy_or():
    b = hashed.bags(Texts(pa.array(["one two. three", "", "four"])))
    assert b.owner.tolist() == [0, 0, 2]
    assert np.allclose(hashed.noisy_or(b, np.array([0.5, 0.5, 0.2])), [0.75, 0, 0.2])


# ---- 10 ------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    trap = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1</p>"
    rows = [(5, "http://a/x?y=1#z", "<p>same</p>"), (2, "https://b.example", "<p>same</p>"), (9, None, "<p>same</p>"), (7, "bad\r\nurl", None),
            (8, "", ""), (3, "http://c/é", trap), (None, "http://d/", "no id"), (11, "http://e/", "x" * 3_000_000), (12, "u", "ÄÖ\n"), (12, "u", "ÄÖ\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = warc.archive_path(spark)
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_records(spark, path))
    got = captures.collect()
    assert len(got) == len(rows) and all(r.request and r.metadata and r.response for r in got)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for r in got:
        if r.record_type == "response":
            html = next(h or "" for i, _, h in rows if i == r.page_id)
            assert bytes(r.response.payload).decode() == html and r.response.sound
    flat = warc.resolve(captures).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                     first[h or ""] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in flat), key=str) == sorted(want, key=str)
    path = warc.archive_path(spark)
    warc.write_archives(pages.limit(0), path)
    assert warc.read_records(spark, path).count() == 0


def test_warc_members():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <1>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    two = one.replace(b"<1>", b"<2>")
    for content in (one + two, gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        assert [(r["record_id"], r["payload"]) for r in warc.parse(content)] == [("<1>", b"body"), ("<2>", b"body")]
    assert [r["record_id"] for r in warc.parse(one + two[:-9])] == ["<1>"]
    assert list(warc.parse(b"")) == []
