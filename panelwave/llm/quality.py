"""Quality scores from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.hashed import Bags, bags, document_means, joined, train_documents
from panelwave.llm.textvec import ALNUM, NOT_SPACE, Texts, annotate, counts_by, sample_texts, slices

#: most texts the scorer is fitted to, and the most bytes of them that reach the driver at once
MAX_TRAIN = 8_000
MAX_TRAIN_BYTES = 24 << 20
FIT_SLICE_BYTES = 1 << 20

#: frequent words of four languages (fixed values)
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "der die das und den von zu mit ist im nicht ein eine auch für auf sich "
    "de la le les et des en un une du que est pour dans qui par "
    "el los las y por con para una como su al lo se"
).split()

_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_SYMBOL = np.array([33 <= c <= 126 and not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-" for c in range(256)])
_LINE = np.array([c not in (10, 13) for c in range(256)])
LABELLERS = ("length", "word_length", "symbols", "stop_words", "repeated_lines", "repeated_words", "capitals", "ends", "variety")
FACTS = ("log_words", "word_length", "symbols", "stop_words", "repeated_lines", "repeated_words", "capitals", "ends", "variety")


def _share(mask: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(owner, minlength=n)
    return np.bincount(owner, weights=mask, minlength=n) / np.maximum(total, 1)


def _again(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for every element whose key stood in its text before."""
    order = np.lexsort((keys, owner))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out


def facts(column: pa.Array) -> np.ndarray:
    """One row of FACTS for each text."""
    t, plain = Texts(column), Texts(column, lower=False)
    n = t.n
    starts, ends, owner = t.words(NOT_SPACE)
    words = counts_by(owner, n)
    hashes = t.hashes(starts, ends)
    bare, bare_ends, bare_owner = t.words(ALNUM)
    stop = Texts(pa.array(STOP_WORDS))
    stop_hashes = np.sort(stop.hashes(*stop.words(ALNUM)[:2]))
    bare_hashes = t.hashes(bare, bare_ends)
    place = np.minimum(np.searchsorted(stop_hashes, bare_hashes), len(stop_hashes) - 1)
    lines, line_ends, line_owner = t.words(_LINE)
    byte_owner = np.repeat(np.arange(n), np.diff(t.offsets))
    letters = _LETTER[plain.data]
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    final = np.isin(t.data[line_ends - 1], np.frombuffer(b".!?", np.uint8)) if len(lines) else np.zeros(0, bool)
    return np.stack([
        np.log1p(words), np.bincount(owner, weights=ends - starts, minlength=n) / np.maximum(words, 1),
        _share(_SYMBOL[plain.data], byte_owner, n), _share(stop_hashes[place] == bare_hashes, bare_owner, n),
        _share(_again(t.hashes(lines, line_ends), line_owner), line_owner, n), _share(follows, owner, n),
        np.bincount(byte_owner, weights=_UPPER[plain.data], minlength=n) / np.maximum(
            np.bincount(byte_owner, weights=letters, minlength=n), 1),
        _share(final, line_owner, n), 1 - _share(_again(hashes, owner), owner, n),
    ], axis=1)


def votes(f: np.ndarray) -> np.ndarray:
    """Votes of the labellers: 1 good, -1 bad, 0 none. A text without words gets bad votes for its length only."""
    c = {name: f[:, k] for k, name in enumerate(FACTS)}
    words = np.expm1(c["log_words"])
    some = words > 0.5

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(some & bad, -1, np.where(some & good, 1, 0))

    out = np.stack([
        np.where(words < 10, -1, np.where(words >= 40, 1, 0)),
        vote((c["word_length"] > 3) & (c["word_length"] < 9), (c["word_length"] < 2.5) | (c["word_length"] > 14)),
        vote(c["symbols"] < 0.01, c["symbols"] > 0.05), vote(c["stop_words"] > 0.15, c["stop_words"] < 0.05),
        vote((c["repeated_lines"] < 0.05) & (words > 60), c["repeated_lines"] > 0.3),
        vote(c["repeated_words"] < 0.03, c["repeated_words"] > 0.15), vote(c["capitals"] < 0.15, c["capitals"] > 0.4),
        vote(c["ends"] > 0.8, c["ends"] < 0.2), vote((c["variety"] > 0.4) | (words > 1500), (c["variety"] < 0.2) & (words < 1500)),
    ], axis=1)
    return out


def code(v: np.ndarray) -> np.ndarray:
    """Vote rows as numbers with base-3 digits."""
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


@dataclass
class LabelModel:
    """prior of good; chance[j, y, v]: labeller j's probability of vote v - 1 for a text of class y."""

    prior: float
    chance: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(
            np.log(self.chance[j])[:, v[:, j] + 1].T for j in range(v.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def fit_labels(v: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote rows and how often each occurs; starts from the majority vote."""
    total = v.sum(axis=1)
    p = np.clip(0.5 + 0.5 * total / np.maximum((v != 0).sum(axis=1), 1), 0.02, 0.98)
    m = LabelModel(0.5, np.full((v.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        m.prior = float(np.clip(weight[1].sum() / weight.sum(), 1e-3, 1 - 1e-3))
        for j in range(v.shape[1]):
            for k in range(3):
                m.chance[j, :, k] = (weight[:, v[:, j] + 1 == k].sum(axis=1) + 1) / (weight.sum(axis=1) + 3)
        new = m.posterior(v)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return m


@dataclass
class Scorer:
    labels: LabelModel
    hashed: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN,
        max_bytes: int = MAX_TRAIN_BYTES) -> Scorer:
    """Label model from the votes on all documents, scorer from at most max_train of them (smallest hashes of ids).

    Vote rows are counted in Spark; there are at most 3^9 distinct ones. Empty table: every score is the prior's.
    """
    schema = T.StructType([T.StructField("code", T.LongType())])
    coded = annotate(docs.select(F.col(text).alias("t")), lambda b: {"code": pa.array(code(votes(facts(b.column(0)))))}, schema, [], "t")
    got = coded.groupBy("code").count().toArrow()
    codes, count = got["code"].to_numpy(), got["count"].to_numpy().astype(float)
    order = np.argsort(codes)
    v = codes[order][:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    k = len(FACTS)
    if not len(codes):
        chance = np.full((len(LABELLERS), 2, 3), 1 / 3)
        return Scorer(LabelModel(0.5, chance), np.zeros(1 << 18), np.zeros(k + 1), np.zeros(k), np.ones(k))
    labels = fit_labels(v, count[order])
    sample = sample_texts(docs, doc_id, text, max_train, max_bytes)

    def pieces() -> Iterator[tuple[Bags, np.ndarray]]:
        for p in slices(sample, "t", FIT_SLICE_BYTES):
            yield bags(Texts(p.column(0))), facts(p.column(0))

    parts = list(pieces())
    f = np.concatenate([x for _, x in parts])
    target = labels.posterior(votes(f))
    mean_, deviation = f.mean(axis=0), np.maximum(f.std(axis=0), 1e-6)
    hashed, dense = train_documents(joined([b for b, _ in parts]), (f - mean_) / deviation, target)
    return Scorer(labels, hashed, dense, mean_, deviation)


def score(docs: DataFrame, model: Scorer, carry: Sequence[str] = ("doc_id",), prefix: str = "", text: str = "text") -> DataFrame:
    """Carried columns with votes, posterior (label model), score (hashed scorer, 0 to 1, higher is better), predicted.

    Null and empty texts have no words: the length labeller votes bad. A carried column named like a result column is
    dropped; no shuffle; the model's size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([
        T.StructField(prefix + "votes", T.ArrayType(T.IntegerType())), T.StructField(prefix + "posterior", T.DoubleType()),
        T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType())])

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = shared.value
        column = batch.column(batch.schema.get_field_index(text))
        f = facts(column)
        v = votes(f)
        total = document_means(bags(Texts(column)), m.hashed) + (f - m.mean) / m.deviation @ m.dense[:-1] + m.dense[-1]
        s = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return {
            prefix + "votes": pa.array(v.tolist(), pa.list_(pa.int32())), prefix + "posterior": pa.array(m.labels.posterior(v)),
            prefix + "score": pa.array(s), prefix + "predicted": pa.array((s >= 0.5).astype(np.int32))}

    return annotate(docs, fn, result, carry, text)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
