"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates mixed by context frequency.

Counts are asked for and answered in packets. Documents are written once as blocks (some MB of text each). A block asks
for the corpus counts of its distinct words and word pairs: one packet for each range of keys, so all questions about a
key meet in one task, already summed per block (a word that makes up a third of the corpus is one key per block). The
answers hold the counts in the order of the keys; joined with their block they give every token's probability. Nothing
of the corpus is broadcast or sent to the driver but sums and the histogram that the mixture weights are learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.textvec import NOT_SPACE, Texts, counts_by, mix, slices
from panelwave.operators.sizing import materialize, ship_package

BLOCK_BYTES = 8 << 20
#: text for each range of keys; decides the number of ranges, so a range's size stays the same as the corpus grows
RANGE_BYTES = 16 << 20
END = np.uint64(0xE7D5A3C19B8F6421)
BINS = 256
CONTEXTS = 64
START_WEIGHTS = (0.01, 0.39, 0.6)

ANSWER = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("words", T.BinaryType()),
    T.StructField("pairs", T.BinaryType()), T.StructField("n_kept", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("v", T.LongType()),
])


# ---- packing -------------------------------------------------------------------------------------
def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: the high bytes of sorted keys and small counts take almost no room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _unpack_rows(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
    return table.to_batches()[0]


# ---- blocks --------------------------------------------------------------------------------------
@dataclass
class Tokens:
    word: np.ndarray  # token keys; every text ends with END
    pair: np.ndarray  # keys of (token before, token); the token before a text's first is END
    owner: np.ndarray  # text of each token
    n: int


def tokens(batch: pa.RecordBatch, text: str) -> Tokens:
    """Lower-cased words between white space, then an end, for each text of the block."""
    keys, sizes = [], []
    for piece in slices(batch, text):
        t = Texts(piece.column(piece.schema.get_field_index(text)))
        starts, ends, owner = t.words(NOT_SPACE)
        keys.append(t.hashes(starts, ends))
        sizes.append(counts_by(owner, t.n))
    words, size = np.concatenate(keys), np.concatenate(sizes)
    n = len(size)
    owner = np.repeat(np.arange(n), size + 1)
    key = np.full(len(owner), END)
    own = np.repeat(np.arange(n), size)
    key[np.arange(len(words)) + own] = words
    before = np.concatenate([[END], key[:-1]]).astype(np.uint64)
    pair = mix(before * np.uint64(0x9FB21C651E98DF25) + mix(key))
    return Tokens(key, pair, owner, n)


def to_blocks(docs: DataFrame, train: Column, deleted: Column, carry: Sequence[str], text: str) -> DataFrame:
    """Written table (block, deleted, rows): the texts of the deleted part make blocks of their own."""
    ship_package(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.coalesce(F.col(text), F.lit("")).alias("text"),
                      F.coalesce(train, F.lit(False)).alias("train"),
                      F.coalesce(train & deleted, F.lit(False)).alias("deleted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            flag = batch.column(batch.schema.get_field_index("deleted"))
            for value in (False, True):
                part = batch.filter(flag if value else pc.invert(flag)).drop_columns(["deleted"])
                for piece in slices(part, "text", BLOCK_BYTES):
                    yield pa.RecordBatch.from_pydict(
                        {"block": [block], "deleted": [value], "rows": [_pack_rows(pa.table(piece).to_batches()[0])]},
                        schema=pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("rows", pa.binary())]))
                    block += 1

    return materialize(own.mapInArrow(run, "block long, deleted boolean, rows binary"))


def _distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how many of their tokens count."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(counted[order].astype(np.int64), first) if len(keys) else first


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of keys begins among sorted keys."""
    width = (1 << 64) // ranges + 1
    return np.searchsorted(keys, np.array([min(k * width, (1 << 64) - 1) for k in range(ranges)] , np.uint64)).tolist() + [len(keys)]


def questions(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, deleted, words, word_counts, pairs, pair_counts) packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = _unpack_rows(row["rows"])
                t = tokens(rows, "text")
                counted = rows.column(rows.schema.get_field_index("train")).to_numpy(zero_copy_only=False)[t.owner]
                (w, wc), (p, pc_) = _distinct(t.word, counted), _distinct(t.pair, counted)
                wb, pb = _bounds(w, ranges), _bounds(p, ranges)
                for k in range(ranges):
                    yield pa.RecordBatch.from_pydict({
                        "range": pa.array([k], pa.int32()), "block": [row["block"]], "deleted": [row["deleted"]],
                        **{name: pa.array([pack(x[b[k] : b[k + 1]])], pa.binary()) for name, x, b in (
                            ("words", w, wb), ("word_counts", wc, wb), ("pairs", p, pb), ("pair_counts", pc_, pb))},
                    })

    return blocks.mapInArrow(run, "range int, block long, deleted boolean, words binary, word_counts binary, "
                                  "pairs binary, pair_counts binary")


def _totals(keys: list[np.ndarray], counts: list[np.ndarray], deleted: list[bool]) -> tuple[np.ndarray, list[bytes]]:
    """Per distinct key (all, deleted) counts, and for each block both counts in the order of its keys."""
    every = np.unique(np.concatenate(keys))
    total = np.zeros((2, len(every)), np.int64)
    places = [np.searchsorted(every, k) for k in keys]
    for place, count, gone in zip(places, counts, deleted):
        total[0, place] += count.astype(np.int64)  # a block's keys are distinct
        if gone:
            total[1, place] += count.astype(np.int64)
    return total, [pack(total[:, place].ravel()) for place in places]


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pydict()
    gone = rows["deleted"]
    words, word_answers = _totals([unpack(x) for x in rows["words"]], [unpack(x) for x in rows["word_counts"]], gone)
    _, pair_answers = _totals([unpack(x) for x in rows["pairs"]], [unpack(x) for x in rows["pair_counts"]], gone)
    n = len(gone)
    first = lambda x: [int(x)] + [0] * (n - 1)  # noqa: E731  sums of a range stand in one of its rows
    return pa.table({
        "block": pa.array(rows["block"], pa.int64()), "range": pa.array(rows["range"], pa.int32()),
        "words": pa.array(word_answers, pa.binary()), "pairs": pa.array(pair_answers, pa.binary()),
        "n_kept": pa.array(first((words[0] - words[1]).sum()), pa.int64()), "n": pa.array(first(words[0].sum()), pa.int64()),
        "v": pa.array(first((words[0] > 0).sum()), pa.int64()),
    })


# ---- mixture -------------------------------------------------------------------------------------
@dataclass
class Mixture:
    """weights[b] = (uniform, unigram, bigram) for contexts of frequency class b; n, v, n_kept: corpus sums."""

    weights: np.ndarray
    n: int
    v: int
    n_kept: int


def context_class(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(float))[1], 0)


def learn_weights(cells: np.ndarray, floor: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation on rows (class, tokens, uniform, unigram, bigram probability).

    A class that no held-out token falls in takes the weights of the nearest class below that has some.
    """
    weights = np.tile(np.array(START_WEIGHTS), (CONTEXTS, 1))
    known = np.zeros(CONTEXTS, bool)
    for b in range(CONTEXTS):
        own = cells[cells[:, 0] == b]
        if len(own):
            w, count, p = np.array(START_WEIGHTS), own[:, 1:2], own[:, 2:]
            for _ in range(rounds):
                share = p * w
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                w = np.maximum((share * count).sum(axis=0) / count.sum(), floor)
                w /= w.sum()
            weights[b], known[b] = w, True
        elif b and known[:b].any():
            weights[b] = weights[b - 1]
    return weights


def _counts(row_answers: list[dict], kind: str) -> np.ndarray:
    """(all, deleted) counts of a block's distinct keys, the answers of all ranges put together."""
    parts = [unpack(r[kind]).reshape(2, -1) for r in sorted(row_answers, key=lambda r: r["range"])]
    return np.concatenate(parts, axis=1).astype(np.int64)


def _token_counts(left: pa.Table, right: pa.Table, kept: bool) -> tuple[pa.RecordBatch, Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, tokens and counts of each token's word, context and pair: without the deleted part if kept, else all."""
    rows = _unpack_rows(left.column("rows")[0].as_py())
    t = tokens(rows, "text")
    answers = right.select(["range", "words", "pairs"]).to_pylist()
    pick = lambda c: c[0] - c[1] if kept else c[0]
    w, where = np.unique(t.word, return_inverse=True)
    count = pick(_counts(answers, "words"))
    before = np.concatenate([[np.searchsorted(w, END)], where[:-1]])
    word, context = count[where], count[before]
    del w, where, before
    return rows, t, word, context, pick(_counts(answers, "pairs"))[np.unique(t.pair, return_inverse=True)[1]]


def _histogram(n_kept: int, v: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("cell", "tokens", "unigram", "bigram")
        if not left.num_rows:
            return pa.table({k: pa.array([], pa.int64() if k == "cell" else pa.float64()) for k in names})
        _, _, word, context, pair = _token_counts(left, right, kept=True)
        p1 = word / max(n_kept, 1)
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        bin_ = lambda p: np.where(p > 0, np.minimum(1 - 4 * np.log2(np.maximum(p, 1e-300)), BINS - 1), 0).astype(np.int64)
        cell, where = np.unique((context_class(context) * BINS + bin_(p2)) * BINS + bin_(p1), return_inverse=True)
        return pa.table({
            "cell": cell, "tokens": np.bincount(where).astype(float), "unigram": np.bincount(where, weights=p1),
            "bigram": np.bincount(where, weights=p2),
        })

    return fn


def _scored(m: Mixture, names: Sequence[str], carry: Sequence[str]):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, t, word, context, pair = _token_counts(left, right, kept=False)
        w = m.weights[context_class(context)]
        p = w[:, 0] / (m.v + 1) + w[:, 1] * word / max(m.n, 1) + w[:, 2] * np.where(
            context > 0, pair / np.maximum(context, 1), 0.0)
        base = np.log10((word + 0.5) / (m.n + 0.5 * (m.v + 1)))
        by = lambda x: np.bincount(t.owner, weights=x, minlength=t.n)
        out = {c: rows.column(rows.schema.get_field_index(n)) for c, n in zip(carry, names)}
        return pa.table(out | {
            "n_tokens": counts_by(t.owner, t.n), "n_known": by((word > 0).astype(float)).astype(np.int64),
            "train_tokens": np.full(t.n, m.n, np.int64), "base_score": by(base), "score": by(np.log10(p)),
        })

    return fn


def score(docs: DataFrame, train: Column, deleted: Column, carry: Sequence[str] = ("doc_id",), text: str = "text",
          ) -> tuple[DataFrame, Mixture]:
    """Carried columns with n_tokens, n_known, train_tokens, base_score and score (log10), and the mixture.

    train says which rows the model learns from; deleted which of these are set aside while the weights are learnt
    (their counts join the model afterwards). The weights maximise the likelihood of the set-aside tokens, given the
    counts of the rest, by context-frequency class; probabilities enter that step as means of narrow cells.

    Null or empty text: one token, the end. Null flags count as false. Without training rows every token has the
    uniform probability. Repeated rows are scored alike and each counts. A carried column named like a result column is
    dropped.
    """
    carry = [c for c in carry if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    blocks = to_blocks(docs, train, deleted, carry, text)
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    answers = materialize(questions(blocks, ranges).groupBy("range").applyInArrow(lambda _, t: _answer(t), ANSWER))
    n, v, n_kept = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_kept")]).head()
    apart = blocks.filter("deleted")
    cells = apart.groupBy("block").cogroup(
        answers.join(apart.select("block"), "block", "left_semi").groupBy("block")
    ).applyInArrow(_histogram(n_kept, v), "cell long, tokens double, unigram double, bigram double")
    got = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("tokens", "unigram", "bigram")]).toArrow()
    cell, count = got["cell"].to_numpy(), got["tokens"].to_numpy()
    table = np.stack([
        cell // (BINS * BINS), count, np.full(len(cell), 1.0 / (v + 1)), got["unigram"].to_numpy() / count,
        got["bigram"].to_numpy() / count,
    ], axis=1) if len(cell) else np.zeros((0, 5))
    m = Mixture(learn_weights(table), n, v, n_kept)
    names = [f"c{i}" for i in range(len(carry))]
    schema = T.StructType([docs.schema[c] for c in carry] + [
        T.StructField(k, T.LongType() if k[0] in "nt" else T.DoubleType())
        for k in ("n_tokens", "n_known", "train_tokens", "base_score", "score")])
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(m, names, carry), schema)
    return out, m


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out, _ = score(docs, ~held, F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
