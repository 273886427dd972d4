"""Near-duplicates by SimHash with bit-sliced comparison.

Equal fingerprints form one class, so copies meet nobody. Two fingerprints that differ in at most r bits agree in one of
r + 1 groups of bits: classes are dealt by the bits of each group. A bucket of more than BUCKET classes is dealt again by
r + 1 groups of the bits that it leaves open (its members agree in the others), and so on: exact at every size, no bucket
is capped, and none is compared in squares. A bucket with b open bits has at most 2^b classes, so this ends.

In a bucket fingerprints stand as vertical bit planes, 64 of them in a word. A fingerprint meets a whole word of others
plane by plane: differing bits are added to carry-save counters that start so high that they overflow beyond the
radius, and a word is left as soon as all of its lanes have overflowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.components import components
from panelwave.llm.textvec import NOT_SPACE, Texts, annotate, counts_by
from panelwave.operators.sizing import materialize, small_side

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
BUCKET = 512
#: rows compared at once, and shingles whose bits are counted at once
CHUNK = 1 << 14
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints --------------------------------------------------------------------------------
def shingle_hashes(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-joined shingles, repeats included, and the text that each belongs to."""
    starts, ends, owner = texts.words(NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = texts.data.tobytes()
    joined = b" ".join([low[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    length = ends - starts
    to = np.cumsum(length + 1) - 1  # ends of the words in the joined bytes
    words = counts_by(owner, texts.n)
    first = np.cumsum(words) - words
    number = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    own = np.repeat(np.arange(texts.n), number)
    at = first[own] + np.arange(len(own)) - (np.cumsum(number) - number)[own]
    last = np.minimum(at + size, first[own] + words[own]) - 1
    begin = (to - length)[at].tolist()
    digest = xxhash.xxh64_intdigest
    hashed = (digest(joined[a:b], SEED) for a, b in zip(begin, to[last].tolist()))
    return np.fromiter(hashed, np.uint64, len(own)), own


def majority(hashes: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit print for each of n texts: the bits that are set in over half of its hashes."""
    set_ = np.zeros((n, BITS), np.int64)
    for k in range(0, len(own), CHUNK):
        of = own[k : k + CHUNK]
        bits = np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        set_[of[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = 2 * set_ > counts_by(own, n)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    """Carried columns with print (long, the 64 bits) and n_shingles; zero where a text has no words."""
    result = T.StructType([T.StructField("print", T.LongType()), T.StructField("n_shingles", T.LongType())])

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = Texts(batch.column(batch.schema.get_field_index(text)))
        hashes, own = shingle_hashes(texts)
        return {"print": pa.array(majority(hashes, own, texts.n).view(np.int64)), "n_shingles": pa.array(counts_by(own, texts.n))}

    return annotate(docs, fn, result, carry, text)


# ---- bit-sliced comparison -----------------------------------------------------------------------
def planes_of(prints: np.ndarray) -> np.ndarray:
    """(words, BITS): bit p of 64 successive prints in one word; lanes past the end are zero."""
    words = -(-len(prints) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    vertical = np.ascontiguousarray(bits.reshape(words, 64, BITS).transpose(0, 2, 1))
    return np.packbits(vertical, axis=2, bitorder="little").view("<u8").reshape(words, BITS)


def _below(lanes: np.ndarray) -> np.ndarray:
    """Words whose first so many lanes (0 to 64) are set."""
    return np.where(lanes >= 64, _FULL, (np.uint64(1) << np.minimum(lanes, 63).astype(np.uint64)) - np.uint64(1))


def within(prints: np.ndarray, stop: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < stop[i], of prints that differ in at most radius bits. Buckets are runs: stop is their end."""
    planes = planes_of(prints)
    own = np.arange(len(prints))
    number = np.where(stop > own + 1, (stop - 1) // 64 - own // 64 + 1, 0)  # words that hold partners
    query = np.repeat(own, number)
    word = query // 64 + np.arange(len(query)) - (np.cumsum(number) - number)[query]
    width = radius.bit_length()
    for k in range(0, len(query), CHUNK):
        q, w = query[k : k + CHUNK], word[k : k + CHUNK]
        lanes = _below(np.clip(stop[q] - 64 * w, 0, 64)) & ~_below(np.clip(q + 1 - 64 * w, 0, 64))
        over = ~lanes  # lanes of other buckets and earlier rows count as left
        spare = (1 << width) - 1 - radius
        counter = [np.full(len(q), _FULL if spare >> c & 1 else 0, np.uint64) for c in range(width)]
        for p in range(BITS):
            carry = planes[w, p] ^ (np.uint64(0) - (prints[q] >> np.uint64(p) & np.uint64(1)))
            for c in range(width):
                counter[c], carry = counter[c] ^ carry, counter[c] & carry
            over |= carry
            if p % 4 == 3:
                stay = over != _FULL
                if not stay.all():
                    q, w, over = q[stay], w[stay], over[stay]
                    counter = [c[stay] for c in counter]
                    if not len(q):
                        break
        if len(q):
            item, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[item], 64 * w[item] + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that links reach, for each of n rows."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect the prints of each bucket (mask, value) as their pairs do: a forest, not the pairs."""

    def linked(value: np.ndarray, mask: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((value[1:] != value[:-1]) | (mask[1:] != mask[:-1])) + 1
        ends = np.concatenate([new, [len(value)]])
        stop = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        label = forest(len(prints), within(prints.view(np.uint64), stop, radius))
        more = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[more]), pa.array(prints[label[more]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            fresh = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("value", "mask", "print")])
            held = np.concatenate([held, fresh], axis=1)
            if held.shape[1] >= CHUNK:
                inside = (held[:2] == held[:2, -1:]).all(axis=0)
                cut = int(np.flatnonzero(~inside)[-1]) + 1 if not inside.all() else 0  # the last bucket may go on
                if cut:
                    yield linked(*(np.ascontiguousarray(x) for x in held[:, :cut]))
                    held = held[:, cut:]
        if held.shape[1]:
            yield linked(*(np.ascontiguousarray(x) for x in held))

    dealt = rows.select("mask", "value", "print").repartition("mask", "value").sortWithinPartitions("mask", "value", "print")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# ---- operator ------------------------------------------------------------------------------------
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut_open_bits(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 groups of the bits it leaves open."""
    free = [p for p in range(BITS) if not mask >> p & 1]
    groups = np.array_split(np.array(free), radius + 1)
    return [mask | sum(1 << int(p) for p in g) for g in groups]


def linked_prints(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(node, label) of the distinct prints (one column, print) that have a partner within the radius."""
    spark = prints.sparkSession
    first = F.array(*[F.lit(_signed(m)) for m in cut_open_bits(0, radius)])
    rows = prints.withColumn("mask", F.explode(first)).withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
    links = None
    while True:
        # at most a (radius + 1) / bucket share of the rows; their masks are at most (radius + 1)^level
        large = materialize(rows.groupBy("mask", "value").count().filter(F.col("count") > bucket).select("mask", "value"))
        masks = [r.mask & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]
        side = small_side(large)
        found = bucket_links(rows.join(side, ["mask", "value"], "left_anti") if masks else rows, radius)
        links = found if links is None else links.unionByName(found)
        if not masks:
            return components(links)
        deeper = spark.createDataFrame(
            [(_signed(m), [_signed(c) for c in cut_open_bits(m, radius)]) for m in masks], "mask long, deeper array<long>")
        rows = rows.join(side, ["mask", "value"], "left_semi").join(F.broadcast(deeper), "mask")
        rows = rows.select("print", F.explode("deeper").alias("mask"))
        rows = materialize(rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask"))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), n_shingles.

    Words are what stands between white space after lower-casing A-Z; shingles are three words, repeats included, a
    shorter text is one. A bit is set where it is in over half of the shingles' XXH64 (seed 42).

    Null, empty or wordless text: fingerprint zero, linked like any other. Equal fingerprints are linked. A null doc_id is
    linked but never the smallest: component_id is null only where the whole component has no id. Repeated rows stay
    rows. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = materialize(fingerprints(named, ["doc_id"]))
    classes = materialize(marks.groupBy("print").agg(F.min("doc_id").alias("rep")))
    labels = materialize(linked_prints(classes.select("print"), radius))
    reps = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "rep", F.coalesce("label", "print").alias("label"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = materialize(reps.join(least, "label").select("print", "component_id"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    # a print that a third of all rows have is split by the skew join: nothing after it needs its placement
    return marks.join(ids, "print").select("doc_id", hexed, "component_id", "n_shingles")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
