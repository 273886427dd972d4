"""Near-duplicates by b-bit MinHash: band candidates, packed low bits, collision-corrected estimate, exact confirmation.

Texts with the same words form one class, so copies cost nothing after the first step. Classes that share a band meet
its smallest class (a star, not all pairs). A pair is first judged by its packed low bits, then by its full shingle
sets. Only bands whose classes are still in different components after that are compared all against all, in blocks of
bounded size and by packed bits alone; what passes there is confirmed as well. So no link between classes that share a
band is lost, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.components import components, roots
from panelwave.llm.textvec import NOT_SPACE, Texts, annotate, counts_by, mix, powers
from panelwave.operators.sizing import materialize

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = 256  # the first BANDS * ROWS make the bands, all of them the estimate; a multiple of 64
PLANES = 4  # low bits kept of each minimum
THRESHOLD = (75, 100)
#: pairs whose estimate is lower are not confirmed; 4.6 standard deviations under the threshold
ESTIMATE = 0.62
BLOCK = 512
#: classes with more than one in so many members are matched by broadcast: there are fewer of them than this
LARGE = 1000

_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEQUENCE = 0xA24BAED4963EE407


@dataclass
class Sets:
    """Shingles of some texts: hashes (with repeats), owner, and for each text the key of its word sequence."""

    shingles: np.ndarray
    begin: np.ndarray  # shingles of text i: begin[i]:begin[i + 1]
    sequence: np.ndarray
    n: int

    def distinct(self, i: int) -> np.ndarray:
        return np.unique(self.shingles[self.begin[i] : self.begin[i + 1]])


def shingle_sets(texts: Texts) -> Sets:
    starts, ends, owner = texts.words(NOT_SPACE)
    size = counts_by(owner, texts.n)
    word_from = np.concatenate([[0], np.cumsum(size)])
    sequence = np.zeros(texts.n, np.uint64)
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not len(starts):
        return Sets(np.zeros(0, np.uint64), begin, sequence, texts.n)
    w = texts.hashes(starts, ends)
    local = np.arange(len(w)) - word_from[owner]
    some = np.flatnonzero(size)
    sums = np.add.reduceat(w * powers(SEQUENCE, int(local.max()) + 1)[local], word_from[some])
    sequence[some] = mix(sums + size[some].astype(np.uint64))
    shingles = np.empty(begin[-1], np.uint64)
    full = size[owner] >= SHINGLE
    at = np.flatnonzero(full & (local + SHINGLE <= size[owner]))
    value = w[at] * _PLACES[0]
    for j in range(1, SHINGLE):
        value = value + w[at + j] * _PLACES[j]
    shingles[begin[owner[at]] + local[at]] = mix(value)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    shingles[begin[short]] = mix(sequence[short] + np.uint64(1))
    return Sets(shingles, begin, sequence, texts.n)


def unpacked_sets(bodies: list[bytes], at_once: int = 32) -> list[np.ndarray]:
    """Distinct shingles of compressed texts, a few texts at a time."""
    inflate = zstandard.ZstdDecompressor().decompress
    out: list[np.ndarray] = []
    for k in range(0, len(bodies), at_once):
        sets = shingle_sets(Texts(pa.array([inflate(x) for x in bodies[k : k + at_once]], pa.binary())))
        out += [sets.distinct(i) for i in range(sets.n)]
    return out


def minima(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their minima: one row for each hash function)."""
    some = np.flatnonzero(np.diff(sets.begin))
    out = np.empty((HASHES, len(some)), np.uint32)
    if len(some):
        first = sets.begin[some]
        low, high = sets.shingles.astype(np.uint32), (sets.shingles >> np.uint64(32)).astype(np.uint32)
        for i, factor in enumerate(_FACTORS):
            out[i] = np.minimum.reduceat(low * factor + high, first)
    return some, out


def packed(values: np.ndarray) -> np.ndarray:
    """Low bits of spread minima as bit planes: (texts, PLANES * HASHES / 64) longs."""
    spread = values * np.uint32(0x9E3779B1)
    spread ^= spread >> np.uint32(15)
    planes = [np.packbits(((spread >> np.uint32(p)) & np.uint32(1)).T.astype(np.uint8), axis=1) for p in range(PLANES)]
    return np.concatenate([np.ascontiguousarray(p).view(np.int64) for p in planes], axis=1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; a key stands for the band's number and its minima."""
    keys = np.zeros((BANDS, values.shape[1]), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + values[r : BANDS * ROWS : ROWS].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(r + 1))
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.ascontiguousarray(keys.T).view(np.int64)


def signatures(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    """Carried columns with seq (key of the word sequence, null without words), n_shingles, low and bands."""
    result = T.StructType([
        T.StructField("seq", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("low", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def lists(rows: np.ndarray, some: np.ndarray, n: int) -> pa.Array:
        size = np.zeros(n + 1, np.int32)
        size[some + 1] = rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(rows.ravel(), pa.int64()))

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = shingle_sets(Texts(batch.column(batch.schema.get_field_index(text))))
        some, values = minima(sets)
        number = np.zeros(sets.n, np.int64)
        number[some] = [len(sets.distinct(i)) for i in some.tolist()]
        return {
            "seq": pa.array(sets.sequence.view(np.int64), mask=number == 0), "n_shingles": pa.array(number),
            "low": lists(packed(values), some, sets.n), "bands": lists(band_keys(values), some, sets.n),
        }

    return annotate(docs, fn, result, carry, text)


def bodies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(seq, body): compressed texts."""
    result = T.StructType([T.StructField("seq", T.LongType()), T.StructField("body", T.BinaryType())])

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = Texts(batch.column(batch.schema.get_field_index(text)))
        sets = shingle_sets(texts)
        press = zstandard.ZstdCompressor(level=3).compress
        at = texts.offsets.tolist()
        return {
            "seq": pa.array(sets.sequence.view(np.int64), mask=np.diff(sets.begin) == 0),
            "body": pa.array([press(texts.raw[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
        }

    return annotate(docs, fn, result, [], text).filter("seq is not null")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: equal lanes, corrected for those that agree by chance."""
    longs = HASHES // 64
    equal = F.lit(HASHES)
    for k in range(longs):
        differ = None
        for p in range(PLANES):
            bits = a[p * longs + k].bitwiseXOR(b[p * longs + k])
            differ = bits if differ is None else differ.bitwiseOR(bits)
        equal = equal - F.bit_count(differ)
    chance = 0.5**PLANES
    return (equal / HASHES - chance) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; texts is (seq, body), one row for each seq."""
    num, den = threshold
    wide = pairs.join(texts.select(F.col("seq").alias("b"), F.col("body").alias("body_b")), "b")
    wide = wide.join(texts.select(F.col("seq").alias("a"), F.col("body").alias("body_a")), "a")
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                piece = batch.slice(i, 128)
                a, b = (piece.column(piece.schema.get_field_index(c)).to_numpy().tolist() for c in "ab")
                found: dict[int, np.ndarray] = {}
                for keys, name in ((a, "body_a"), (b, "body_b")):
                    column = piece.column(piece.schema.get_field_index(name))
                    fresh = [j for j, k in enumerate(keys) if k not in found and found.setdefault(k, None) is None]
                    for j, own in zip(fresh, unpacked_sets([column[j].as_py() for j in fresh])):
                        found[keys[j]] = own
                good = []
                for x, y in zip(a, b):
                    s, t = found[x], found[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(den * both >= num * (len(s) + len(t) - both))
                yield piece.select(names).filter(pa.array(good))

    return wide.select(*names, "body_a", "body_b").mapInArrow(run, pairs.schema)


def _blocks(rows: DataFrame, size: str) -> DataFrame:
    """Rows of a bucket dealt to pairs (i, j) of blocks of about BLOCK rows; own is the block of the row itself.

    Work on a bucket that mixes many unlinked classes grows with the square of its size, spread over tasks. What the
    tasks put out does not: rows, or one link for a class and a component.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("seq"), blocks).cast("int")
    cut = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", size)
    return cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (bucket, i, j) as one table for each of these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist() if len(keys) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if hi > lo:
                key = tuple(keys[lo].tolist())
                if held and key != last:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _likely(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a block pair that have different labels, pass the estimate and share no earlier band."""
    seq, label, own = (table.column(c).to_numpy() for c in ("seq", "label", "own"))
    n, longs = len(seq), HASHES // 64
    low = np.array(table.column("low").combine_chunks().flatten()).reshape(n, -1)
    bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(n, -1)
    band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    least = HASHES * (ESTIMATE * (1 - 0.5**PLANES) + 0.5**PLANES)
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        equal = np.full((len(rows), len(right)), HASHES, np.int32)
        for x in range(longs):
            differ = np.zeros(equal.shape, np.int64)
            for p in range(PLANES):
                differ |= low[rows, p * longs + x][:, None] ^ low[right, p * longs + x][None, :]
            equal -= np.bitwise_count(differ.view(np.uint64))
        a, b = np.nonzero((equal >= least) & (label[rows][:, None] != label[right][None, :]))
        a, b = rows[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        first = (bands[a] == bands[b]).argmax(axis=1) == band
        yield a[first], b[first]


def _engaged(rows: DataFrame) -> DataFrame:
    """(bucket, seq) of the rows that have a likely partner of another component in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            used = np.zeros(table.num_rows, bool)
            for a, b in _likely(table):
                used[a] = used[b] = True
            if used.any():
                yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().filter(pa.array(used)) for c in ("bucket", "seq")], ["bucket", "seq"])

    return _blocks(rows, "size").mapInArrow(run, "bucket long, seq long").distinct()


def _block_links(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b, la, lb) inside buckets: one for each class and component at most, from rows with bodies."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            seq, label = table.column("seq").to_numpy(), table.column("label").to_numpy()
            own = unpacked_sets(table.column("body").to_pylist())
            linked: set[tuple[int, int]] = set()
            out = []
            for a, b in _likely(table):
                for x, y in zip(a.tolist(), b.tolist()):
                    if (x, label[y]) in linked and (y, label[x]) in linked:
                        continue
                    s, t = own[x], own[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if den * both >= num * (len(s) + len(t) - both):
                        linked |= {(x, label[y]), (y, label[x])}
                        out.append((seq[x], seq[y], label[x], label[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "la", "lb"])

    return _blocks(rows, "size").mapInArrow(run, "a long, b long, la long, lb long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``groups`` without its key: doc_id, n_shingles, component_id, kept."""
    return groups(docs, doc_id, text, threshold).select("doc_id", "n_shingles", "component_id", "kept")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD,
           carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, carried columns, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id = component_id)
    and component_key, which tells components apart whose rows have no id or share one (null without words).

    Words are what stands between white space after lower-casing A-Z; a text's set holds its distinct shingles of five
    words, a shorter text's whole sequence. Texts whose sets overlap by at least 75 in 100 are linked.

    Null, empty or wordless text: n_shingles 0, a component of its own. Repeated rows of one doc_id with one text are
    alike (all kept, if one is); a null doc_id is linked but never the smallest: its row is kept only where its whole
    component has no id. Threshold pairs that tie are linked.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col(text).alias("text"))
    sig = materialize(signatures(named, ["doc_id", *[f"__c{i}" for i in range(len(carry))]]))
    classes = sig.filter("seq is not null").groupBy("seq").agg(
        F.min("doc_id").alias("rep"), F.first("low").alias("low"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    classes = materialize(classes)
    low = classes.select("seq", "low")
    members = classes.select("seq", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(members.join(sizes, "bucket"))
    # a bucket's leader is the class that meets most others in all its buckets: among copies of one text with edits
    # that is the text itself, to which they are nearer than to one another
    degree = buckets.groupBy("seq").agg(F.sum("size").alias("degree"))
    placed = buckets.join(degree, "seq")
    leaders = placed.groupBy("bucket").agg(F.max_by("seq", F.struct("degree", -F.col("seq"))).alias("leader"))
    stars = buckets.join(leaders, "bucket").filter("seq != leader")
    stars = stars.select(F.col("leader").alias("a"), F.col("seq").alias("b")).distinct()
    stars = stars.join(low.select(F.col("seq").alias("b"), F.col("low").alias("low_b")), "b").join(
        low.select(F.col("seq").alias("a"), F.col("low").alias("low_a")), "a")
    stars = materialize(stars.select("a", "b", estimate(F.col("low_a"), F.col("low_b")).alias("likeness")).filter(
        F.col("likeness") >= ESTIMATE))

    # texts of all classes that share a bucket with another; copies are put together before they are sent to a class
    needed = degree.select("seq")
    texts = materialize(bodies(docs.select(F.col(text).alias("text"))).groupBy("seq").agg(F.first("body").alias("body")).join(
        needed, "seq", "left_semi"))
    # first each class with its likeliest leader: that makes a forest, as leaders have
    # higher degrees or, among equals, smaller keys
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a")).select("a", "b")
    tree = materialize(confirm(best, texts, threshold))
    labels = roots(tree.select(F.col("b").alias("node"), F.col("a").alias("parent")))

    def labelled(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components, with the labels of these."""
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        both = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        both = both.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
        return both.filter("la != lb").select("a", "b", "la", "lb")

    def joined(more: DataFrame) -> DataFrame:
        """Labels after linking components; more has label pairs."""
        top = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(
            F.col("node").alias("label"), F.col("label").alias("top"))
        every = labels.unionByName(top.select(F.col("label").alias("node"), "label")).distinct()
        return materialize(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))

    # then the star pairs that are still apart
    more = materialize(confirm(labelled(stars), texts, threshold))
    if not more.isEmpty():
        labels = joined(more)
    # buckets that still mix components: all against all in blocks, first by packed bits, then, where these leave
    # likely pairs, by full sets
    own = buckets.join(labels.withColumnRenamed("node", "seq"), "seq", "left").withColumn("label", F.coalesce("label", "seq"))
    mixed = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    mixed = mixed.filter("lo != hi and n > 2").select("bucket")
    own = own.join(mixed, "bucket", "left_semi").join(classes.select("seq", "low", "bands"), "seq")
    engaged = materialize(_engaged(own))
    if not engaged.isEmpty():
        size = engaged.groupBy("bucket").agg(F.count("*").alias("size"))
        rows = own.drop("size").join(engaged, ["bucket", "seq"]).join(size, "bucket").join(texts, "seq")
        more = materialize(_block_links(rows, threshold))
        if not more.isEmpty():
            labels = joined(more)

    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()  # roots name themselves
    reps = labels.join(classes.select(F.col("seq").alias("node"), "rep"), "node")
    smallest = reps.join(reps.groupBy("label").agg(F.min("rep").alias("component")), "label").select(
        F.col("node").alias("seq"), "component", "label")
    ids = materialize(classes.select("seq", "rep", "n").join(smallest, "seq", "left").select(
        "seq", "n", F.coalesce("component", "rep").alias("component_id"), F.coalesce("label", "seq").alias("component_key")))
    # members go to their classes: fewer than LARGE classes can have over 1 / LARGE of all members, and are broadcast;
    # rows without words need no class
    members = ids.agg(F.sum("n")).head()[0] or 0
    large = F.broadcast(ids.filter(F.col("n") * LARGE > members).drop("n"))
    rows = sig.drop("low", "bands")
    none = rows.filter("seq is null").withColumns({"component_id": F.col("doc_id"), "component_key": F.lit(None).cast("long")})
    worded = rows.filter("seq is not null")
    in_large = worded.join(large, "seq")
    others = worded.join(large, "seq", "left_anti").join(ids.drop("n"), "seq")
    out = none.unionByName(in_large).unionByName(others)
    return out.select("doc_id", *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component_key")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
