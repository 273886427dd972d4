"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from labels of whole texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.hashed import PREFIXES, Bags, bags, document_counts, noisy_or, only, sentence_scores, telling, train_instances
from panelwave.llm.textvec import Texts, annotate, slices
from panelwave.operators.sizing import materialize, ship_package, spread

#: most labelled texts that the model is fitted to, and the most bytes of them
MAX_TRAIN = 12_000
MAX_TRAIN_BYTES = 32 << 20
FIT_SLICE_BYTES = 1 << 20

SPAN = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()),
])
SPAN_ARROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


@dataclass
class SentenceModel:
    weights: np.ndarray
    bias: float


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id, so such a row is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def _spread_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of the sample have each feature and the sum of their labels, counted where the texts are."""
    schema = T.StructType([T.StructField("f", T.IntegerType()), T.StructField("every", T.DoubleType()), T.StructField("marked", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, marked = np.zeros(1 << 18), np.zeros(1 << 18)
        for batch in batches:
            for p in slices(batch, "t", FIT_SLICE_BYTES):
                more = document_counts(bags(Texts(p.column(0))), p.column(1).to_numpy().astype(float))
                every, marked = every + more[0], marked + more[1]
        f = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(every[f]), pa.array(marked[f])], ["f", "every", "marked"])

    got = sample.select("t", "y").mapInArrow(run, schema).groupBy("f").agg(
        F.sum("every").alias("every"), F.sum("marked").alias("marked")).toArrow()
    every, marked = np.zeros(1 << 18), np.zeros(1 << 18)
    f = got["f"].to_numpy()
    every[f], marked[f] = got["every"].to_numpy(), got["marked"].to_numpy()
    return every, marked


def _spread_bags(sample: DataFrame, keep: np.ndarray) -> tuple[Bags, np.ndarray]:
    """The sample's texts in order as bags of the kept features, with their labels; texts stay where they are."""
    shared = sample.sparkSession.sparkContext.broadcast(keep)
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("sentences", T.IntegerType()),
                           T.StructField("features", whole), T.StructField("sentence", whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, "t", FIT_SLICE_BYTES):
                b = only(bags(Texts(p.column(0))), shared.value)
                first = np.searchsorted(b.owner, np.arange(b.n + 1))  # sentences, then words, of each text
                word = np.searchsorted(b.sentence, first).astype(np.int32)
                local = b.sentence - first[b.owner[b.sentence]] if len(b.sentence) else b.sentence
                yield pa.RecordBatch.from_arrays([
                    p.column(2).cast(pa.int32()), p.column(1).cast(pa.int32()), pa.array(np.diff(first).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(word * b.features.shape[1]), pa.array(b.features.ravel().astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(word), pa.array(local.astype(np.int32)))], schema.fieldNames())

    got = sample.select("t", "y", "pos").mapInArrow(run, schema).orderBy("pos").toArrow().combine_chunks()
    count = got["sentences"].to_numpy().astype(np.int64)
    starts = np.cumsum(count) - count
    features, local = got["features"].combine_chunks(), got["sentence"].combine_chunks()
    words = np.diff(local.offsets.to_numpy()).astype(np.int64)
    none = np.zeros(0, np.int64)  # byte ranges are not needed for training
    made = Bags(features.flatten().to_numpy().reshape(-1, 1 + len(PREFIXES)), local.flatten().to_numpy() + np.repeat(starts, words),
                np.repeat(np.arange(len(count)), count), none, none, len(count))
    return made, got["y"].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
        max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> SentenceModel:
    """Fit to at most max_train labelled texts outside fold 0, those with the smallest hashes of their ids.

    A label is 0 or 1; rows with a null label or id are left out, contradicting labels of one id count as 1. Equal
    texts count once. Only features that toxic texts have significantly more often are given weights; only their
    numbers reach the driver, not the texts. Without labelled texts every score is near 0.
    """
    named = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter("y is not null")
    named = named.filter(fold(F.col("i")) != 0).groupBy("i").agg(F.max("y").alias("y"))
    chosen = named.orderBy(F.xxhash64("i"), "i").limit(max_train)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(chosen, "i").groupBy("i", "y").agg(
        F.min("t").alias("t"))  # rows that share an id count once, so no more rows than ids
    mean = rows.agg(F.avg(F.octet_length("t"))).head()[0] or 1.0
    keep = max(1, min(max_train, int(max_bytes / max(mean, 1.0))))
    got = rows.select(F.xxhash64("i").alias("o"), "i", "y", "t", F.xxhash64("t").alias("h")).orderBy("o", "i", "h").limit(keep)
    fresh = got.groupBy("h").agg(F.min(F.struct("o", "i", "y", "t")).alias("r")).select("r.*")  # equal texts count once
    ship_package(docs.sparkSession)
    sample = materialize(fresh.select("t", "y", (F.row_number().over(Window.orderBy("o", "i")) - 1).alias("pos")))
    sample = spread(sample, "pos")
    n, marked = sample.agg(F.count("*"), F.sum("y")).head()
    if not n:
        return SentenceModel(np.zeros(1 << 18), -8.0)
    made, y = _spread_bags(sample, telling(*_spread_counts(sample), marked / n))
    weights, bias = train_instances(made, y)
    return SentenceModel(weights, bias)


def score(docs: DataFrame, model: SentenceModel, carry: Sequence[str] = ("doc_id",), prefix: str = "",
          text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Carried columns with score, predicted and sentences (byte ranges of the sentences that make a text toxic).

    Null, empty or wordless texts score 0. The model's size is fixed (2^18 weights), so it is broadcast. A rejected
    text names each sentence of at least half its highest sentence score. A carried column named like a result column
    is dropped; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([
        T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType()),
        T.StructField(prefix + "sentences", T.ArrayType(SPAN)),
    ])

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = shared.value
        b = bags(Texts(batch.column(batch.schema.get_field_index(text))))
        s = sentence_scores(b, m.weights, m.bias)
        p = noisy_or(b, s)
        spans: list[list[dict]] = [[] for _ in range(b.n)]
        if len(s):
            most = np.zeros(b.n)
            np.maximum.at(most, b.owner, s)
            for k in np.flatnonzero((p[b.owner] >= threshold) & (s >= most[b.owner] / 2)).tolist():
                spans[b.owner[k]].append({"start": int(b.start[k]), "end": int(b.end[k]), "score": float(s[k])})
        return {
            prefix + "score": pa.array(p), prefix + "predicted": pa.array((p >= threshold).astype(np.int32)),
            prefix + "sentences": pa.array(spans, pa.list_(SPAN_ARROW)),
        }

    return annotate(docs, fn, result, carry, text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "sentences")
