"""Target-distribution importance resampling with n-gram buckets from prefix CRCs.

A document's words, joined by one space, are scanned once with a running CRC32 that is noted where words begin and end.
The CRC of any run of words follows from two of these: the CRC before the run, shifted by the run's length over GF(2),
cancels out of the CRC after it. So no n-gram is built or read again, whatever n is.

Buckets are counted over all documents and all target texts, each bucket gains the logarithm of its frequency ratio, a
document weighs the mean gain of its features, and adding Gumbel noise of its id and taking the highest scores draws
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.textvec import ALNUM, SLICE_BYTES, Texts, annotate, counts_by, slices
from panelwave.operators.sizing import materialize, ship_package

NGRAM = 2
BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
_POLYNOMIAL = 0xEDB88320  # CRC-32, bits reversed
_DIGIT = 64  # lengths are shifted digit by digit in this base


# ---- CRCs of word runs ---------------------------------------------------------------------------
def _tables(columns: np.ndarray) -> np.ndarray:
    """(4, 256) lookup of a linear map of 32 bits, given by the images of single bits."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            with_bit = (np.arange(256) >> bit & 1).astype(bool)
            out[byte, with_bit] ^= columns[8 * byte + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (tables[0, x & np.uint32(255)] ^ tables[1, x >> np.uint32(8) & np.uint32(255)]
            ^ tables[2, x >> np.uint32(16) & np.uint32(255)] ^ tables[3, x >> np.uint32(24)])


def _one_byte() -> np.ndarray:
    """Images of single bits when one zero byte follows."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return x


class Shift:
    """CRCs moved past so many bytes: multiplication by x^(8 length) over GF(2)."""

    def __init__(self) -> None:
        self._places: list[np.ndarray] = []  # (digit, byte, value) for each place of the length

    def _place(self, p: int) -> np.ndarray:
        while len(self._places) <= p:
            if self._places:
                unit = _apply(self._places[-1][-1], _apply(self._places[-1][1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
            else:
                unit = _one_byte()
            step, columns = _tables(unit), np.uint32(1) << np.arange(32, dtype=np.uint32)
            digits = []
            for _ in range(_DIGIT):
                digits.append(_tables(columns))
                columns = _apply(step, columns)
            self._places.append(np.stack(digits))
        return self._places[p]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        crc, length, p = crc.astype(np.uint32), length.astype(np.int64), 0
        while len(length) and length.max() > 0:
            table, digit = self._place(p), length % _DIGIT
            crc = (table[digit, 0, crc & np.uint32(255)] ^ table[digit, 1, crc >> np.uint32(8) & np.uint32(255)]
                   ^ table[digit, 2, crc >> np.uint32(16) & np.uint32(255)] ^ table[digit, 3, crc >> np.uint32(24)])
            length, p = length // _DIGIT, p + 1
        return crc


shift = Shift()


class Runs:
    """Words of a slice with the running CRC of their document before and after each."""

    def __init__(self, texts: Texts):
        starts, ends, self.owner = texts.words(ALNUM)
        self.n = texts.n
        raw = texts.data.tobytes()
        first = np.diff(self.owner, prepend=-1) > 0
        before, after, crc = [], [], 0
        for a, b, new in zip(starts.tolist(), ends.tolist(), first.tolist()):
            crc = 0 if new else crc32(b" ", crc)
            before.append(crc)
            crc = crc32(raw[a:b], crc)
            after.append(crc)
        self.before, self.after = np.array(before, np.uint32), np.array(after, np.uint32)
        size = ends - starts
        self.end = np.cumsum(size + 1) - 1  # in the joined words
        self.begin = self.end - size
        self.words = counts_by(self.owner, self.n)

    def crcs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC of every run of n words inside a document, and the document it is in."""
        last = np.arange(n - 1, len(self.owner))
        at = last - (n - 1)
        inside = self.owner[at] == self.owner[last]
        at, last = at[inside], last[inside]
        return self.after[last] ^ shift(self.before[at], self.end[last] - self.begin[at]), self.owner[at]


def features(texts: Texts, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, document of each feature, words of each document)."""
    runs = Runs(texts)
    found = [runs.crcs(n) for n in range(1, ngram + 1)]
    return np.concatenate([c for c, _ in found]) % np.uint32(buckets), np.concatenate([o for _, o in found]), runs.words


# ---- counts, gains, weights ----------------------------------------------------------------------
def bucket_counts(rows: DataFrame, text: str, ngram: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts; a task sends at most one row for each bucket."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                total += np.bincount(features(Texts(piece.column(0)), ngram, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "number"])

    found = rows.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, number long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("number").alias("number")).collect():  # at most one row for each bucket
        out[r.bucket] = r.number
    return out


def gains(spark: SparkSession, own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of smoothed target frequency over smoothed own frequency, for each bucket."""
    k = len(own)
    rows = spark.createDataFrame([(i, int(s), int(t)) for i, (s, t) in enumerate(zip(own, target))], "b int, s long, t long")
    up = (F.col("t") + 1).cast("double") * F.lit(float(own.sum() + k))
    down = (F.col("s") + 1).cast("double") * F.lit(float(target.sum() + k))
    got = rows.select("b", F.floor(F.lit(1000.0) * F.log(up / down)).alias("g")).collect()  # one row for each bucket
    out = np.zeros(k, np.int64)
    for r in got:
        out[r.b] = r.g
    return out


def weigh(docs: DataFrame, gain: np.ndarray, carry: Sequence[str], text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """Carried columns with n_words, n_features and weight (floored mean gain of the features; none: 0)."""
    result = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = Texts(batch.column(batch.schema.get_field_index(text)))
        bucket, own, words = features(texts, ngram, len(gain))
        number = counts_by(own, texts.n)
        total = np.zeros(texts.n, np.int64)
        np.add.at(total, own, gain[bucket])
        return {"n_words": pa.array(words), "n_features": pa.array(number), "weight": pa.array(total // np.maximum(number, 1))}

    return annotate(docs, fn, result, carry, text)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times Gumbel noise that is fixed by the id; null counts as an empty id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with rank 1, 2, 3 ... over the whole table, without one task that sees all of them.

    Rows are dealt to ranges of the order, numbered inside their range, and moved by the sizes of the ranges before.
    Rows that agree in the order are told apart by where they stand, so that even one key in all rows is split.
    """
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    keys = [*order, F.col("__at")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    numbered = materialize(dealt.withColumns({
        "__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    # one row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop(
        "__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn), one row for each document.

    Words are runs of bytes other than ASCII controls, blanks and punctuation, after lower-casing A-Z; features are runs
    of 1 to ngram words. Of the documents with least_words words or more, percent in 100 (rounded down) of the highest
    scores are drawn; equal scores go to the smaller doc_id.

    Null, empty or wordless text: no features, weight 0, never drawn. A null id has the noise of an empty one and comes
    first among equal scores. Repeated rows are rows of their own, with equal scores and successive ranks. Empty target:
    gains fall with a bucket's own frequency. Empty documents: no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gain = gains(spark, bucket_counts(named, "text", ngram, buckets), bucket_counts(target, target_text, ngram, buckets))
    rows = weigh(named, gain, ["doc_id"], "text", ngram)
    rows = materialize(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked(fit, order).select(*names, rank.alias("rank")).unionByName(rest)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH table_ AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
words AS (SELECT 0 AS kind, doc_id, row_number() OVER () AS i, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, NULL, -row_number() OVER (), regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feats AS (SELECT kind, i, unnest(w) AS f FROM words
  UNION ALL SELECT kind, i, unnest(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) FROM words WHERE len(w) > 1),
bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feats)),
crc AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT)),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS b FROM bytes, table_),
hits AS (SELECT kind, i, b FROM feats JOIN crc USING (f)),
counts AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM hits GROUP BY b),
sums AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gain AS (SELECT b, floor(1000 * ln((CAST(c.t + 1 AS DOUBLE) * CAST(a.s + 10000 AS DOUBLE)) / (CAST(c.s + 1 AS DOUBLE) * CAST(a.t + 10000 AS DOUBLE)))) AS g
  FROM counts c, sums a),
mean AS (SELECT i, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM hits JOIN gain USING (b) WHERE kind = 0 GROUP BY i),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN mean USING (i) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS r,
    count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM placed
"""
