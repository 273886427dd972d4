"""SentencePiece encoding and decoding by a forward pass over sorted words that reuses the scores of common prefixes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelwave.llm.textvec import annotate

MARK = "▁"
#: words kept during a task and judged pairs of pieces kept by a worker; beyond these numbers a table starts anew
KEPT_WORDS = 200_000
KEPT_PAIRS = 400_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What encoding needs of a model file: pieces with scores and kinds, the algorithm, the white-space rules."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int = UNIGRAM
    dummy_prefix: bool = True
    number: dict[str, int] = field(init=False)
    byte_ids: dict[int, int] = field(init=False)
    unknown: int = field(init=False)
    endings: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.number = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        # every ending of a piece, with the piece's number if it is one itself: a search for pieces that end somewhere
        # goes back no further than some piece does
        self.endings = {p[k:]: -1 for p in self.number for k in range(len(p))} | self.number
        if any(MARK in p.lstrip(MARK) for p in self.number):
            raise ValueError("a piece goes over a word boundary; this encoder works word by word")


def load(path: str) -> Model:
    """Read a .model file. Normalisation rules and removal of extra spaces are not supported and raise."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, algorithm, dummy = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            algorithm = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            dummy = bool(own.get(3, 1))
            if own.get(2) or own.get(4, 1):
                raise ValueError("models with a normalisation map or removal of extra spaces are not supported")
    return Model(pieces, scores, kinds, algorithm, dummy)


class Encoder:
    """Word table of one worker.

    Distinct words are sorted, so that walking through them is a depth-first walk of their trie: going to the next
    word keeps the forward states of the common prefix and computes the rest. A state says how the best segmentation
    of a prefix ends: (start of the last piece, its number, score).

    Unigram models: the score of a prefix is the best sum of piece scores, the longer last piece winning ties.

    BPE models: the sum of merge ranks is not what such a model maximises, so paths get weight 0 or minus infinity: two
    pieces may follow one another only if merging their joined text leaves exactly these two. A prefix has exactly one
    such path, and it is the segmentation that merging the whole prefix gives.
    """

    def __init__(self, model: Model, beside: dict[int, bool] | None = None, alone: dict[int, bool] | None = None):
        self.model = model
        self.table: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.beside = {} if beside is None else beside
        self.alone = {} if alone is None else alone
        known = "".join(re.escape(c) for c in model.number if len(c) == 1 and c != MARK)
        # a character that is no piece never joins another, so it is a word of its own
        self.find = re.compile(f"{MARK}+[{known}]*|[{known}]+|[^{known}{MARK}]" if known else f"{MARK}+|[^{MARK}]", re.S).findall

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: the best-scored neighbouring pair first, the leftmost among equals."""
        number, scores = self.model.number, self.model.scores
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                joined = number.get(parts[i] + parts[i + 1])
                if joined is not None and scores[joined] > best:
                    best, at = scores[joined], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        key = a * len(self.model.pieces) + b
        found = self.beside.get(key)
        if found is None:
            left, right = self.model.pieces[a], self.model.pieces[b]
            found = self.beside[key] = self.merged(left + right) == [left, right]
        return found

    def stands(self, a: int) -> bool:
        found = self.alone.get(a)
        if found is None:
            found = self.alone[a] = len(self.merged(self.model.pieces[a])) == 1
        return found

    def advance_bpe(self, word: str, end: int, states: list) -> tuple[int, int, float]:
        find, beside, kinds = self.model.endings.get, self.beside, len(self.model.pieces)
        for start in range(end - 1, -1, -1):
            piece = find(word[start:end])
            if piece is None:
                break
            if piece < 0:
                continue
            if start == 0:
                if self.stands(piece):
                    return 0, piece, 0.0
                break
            last = states[start][1]
            good = beside.get(last * kinds + piece)
            if good or good is None and self.follows(last, piece):
                return start, piece, 0.0
        return end - 1, self.model.unknown, 0.0  # a mark that is no piece

    def advance_unigram(self, word: str, end: int, states: list) -> tuple[int, int, float]:
        find, scores = self.model.endings.get, self.model.scores
        best = None
        for start in range(end - 1, -1, -1):
            piece = find(word[start:end])
            if piece is None:
                break
            if piece >= 0:
                total = states[start][2] + scores[piece]
                if best is None or total >= best[2]:
                    best = start, piece, total
        return best or (end - 1, self.model.unknown, states[end - 1][2] + min(scores) - 10)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not in the table yet."""
        if len(self.table) > KEPT_WORDS:
            self.table, self.flat, self.begin = {}, self.flat[:0], self.begin[:1]
        if len(self.beside) > KEPT_PAIRS:
            self.beside.clear()
        model = self.model
        advance = self.advance_bpe if model.algorithm == BPE else self.advance_unigram
        states: list = [(0, -1, 0.0)]
        last = ""
        flat: list[int] = []
        sizes: list[int] = []
        at_word = len(self.table)
        for word in sorted(w for w in words if w not in self.table):
            if len(word) == 1 and word not in model.number and word != MARK:
                ids = [model.byte_ids.get(b, model.unknown) for b in word.encode()] if model.byte_ids else [model.unknown]
            else:
                shared, most = 0, min(len(word), len(last))
                while shared < most and word[shared] == last[shared]:
                    shared += 1
                del states[shared + 1 :]
                for end in range(shared + 1, len(word) + 1):
                    states.append(advance(word, end, states))
                last = word
                ids, at = [], len(word)
                while at > 0:
                    start, piece, _ = states[at]
                    ids.append(piece)
                    at = start
                ids.reverse()
            self.table[word] = at_word
            at_word += 1
            flat += ids
            sizes.append(len(ids))
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.array(sizes, np.int64))])

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; a null or empty text has no pieces."""
        lead = MARK if self.model.dummy_prefix else ""
        words = [self.find(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*words))
        rows = np.array(list(map(self.table.__getitem__, chain.from_iterable(words))), np.int64)
        begin, flat = self.begin, self.flat
        size = begin[rows + 1] - begin[rows]
        stops = np.cumsum(size)
        at = np.repeat(begin[rows] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
        bounds = np.cumsum([0, *map(len, words)])
        return np.concatenate([[0], stops])[bounds], flat[at]


def decode(model: Model, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(byte offsets, bytes) of the texts that id lists stand for; control pieces stand for nothing."""
    table = [
        bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, 4) else
        " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)
    ]
    flat = np.frombuffer(b"".join(table), np.uint8)
    begin = np.cumsum([0, *map(len, table)])
    size = begin[ids + 1] - begin[ids]
    stops = np.cumsum(size)
    at = np.repeat(begin[ids] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
    data = flat[at]
    bounds = np.concatenate([[0], stops])[offsets]
    if model.dummy_prefix:  # the leading space of a text is the encoder's own
        drop = bounds[:-1][(bounds[1:] > bounds[:-1])]
        drop = drop[data[drop] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        bounds = bounds - np.searchsorted(drop, bounds)
        data = data[keep]
    return bounds, data.tobytes()


_pairs: dict[int, tuple[dict[int, bool], dict[int, bool]]] = {}  # by broadcast, of the one model in use


def encode(docs: DataFrame, model_path: str, carry: Sequence[str] = ("doc_id",), prefix: str = "",
           text: str = "text") -> DataFrame:
    """Carried columns with ids (piece numbers), n_pieces and round_trip (decoding the ids gives the text back).

    The ids are those of the library's own encoder. The model (a vocabulary of fixed size) is broadcast; a task keeps the
    words it has met, up to a bound, so repeated words cost one look-up. Null or empty text: no pieces,
    round_trip true. A text that holds the mark (U+2581) itself comes back with a space there, as from the library. A carried column named like a result column is dropped; no shuffle.
    """
    model = load(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([
        T.StructField(prefix + "ids", T.ArrayType(T.IntegerType())), T.StructField(prefix + "n_pieces", T.LongType()),
        T.StructField(prefix + "round_trip", T.BooleanType()),
    ])

    held: list[Encoder] = []  # every task unpickles its own, so a word table ends with its task

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = shared.value
        if not held:
            if id(m) not in _pairs:
                _pairs.clear()
                _pairs[id(m)] = {}, {}
            held.append(Encoder(m, *_pairs[id(m)]))
        encoder = held[0]
        column = batch.column(batch.schema.get_field_index(text))
        texts = column.to_pylist()
        offsets, ids = encoder.encode(texts)
        bounds, data = decode(m, offsets, ids)
        back = [data[a:b] == (t or "").encode() for t, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist())]
        return {
            prefix + "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
            prefix + "n_pieces": pa.array(np.diff(offsets)), prefix + "round_trip": pa.array(back, pa.bool_()),
        }

    return annotate(docs, fn, result, carry, text)


def default_model() -> str:
    """The installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
