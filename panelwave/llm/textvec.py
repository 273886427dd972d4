"""Whole Arrow batches of text as flat byte arrays: words, hashes, and the map over documents.

Everything here works on one slice of a few MB at a time, so a task's memory does not grow with its partition. Only
a single text longer than a slice makes a slice larger (about 40 bytes of scratch space per byte of that text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelwave.operators.sizing import ship_package

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: byte tables: True where a byte belongs to a word
NOT_SPACE = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per worker and doubled when a longer slice comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Texts of one slice: bytes, offsets (n + 1), lower-cased bytes and a rolling hash over all of them."""

    def __init__(self, column: pa.Array, lower: bool = True):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        self.n = n
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None and n else b""
        self.raw = bytes(data)
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(self.raw.translate(_LOWER) if lower else self.raw, np.uint8)
        self._prefix: np.ndarray | None = None

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of every maximal run of bytes that table marks; runs end with their text."""
        size = len(self.data)
        if not size:
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = table[self.data]
        cut = np.zeros(size + 1, bool)
        cut[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, self.owner(starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the (lower-cased) bytes of each range."""
        if self._prefix is None:
            terms = powers(BASE, len(self.data)) * (self.data.astype(np.uint64) + np.uint64(1))
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        inverse = powers(_INVERSE, len(self.data) + 1)
        value = (self._prefix[ends] - self._prefix[starts]) * inverse[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def counts_by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of text; a longer text gets a piece of its own."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += size
    yield batch.slice(start, n - start)


def sample_texts(docs: DataFrame, doc_id: str, text: str, most: int, max_bytes: int) -> pa.RecordBatch:
    """At most so many distinct (id, text) rows, those with the smallest hashes of their ids, as one column t.

    Keys are chosen on narrow rows, texts are fetched for the chosen ones only; both bounds are on what reaches the
    driver. Repeated rows count once.
    """
    keyed = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    mean = keyed.agg(F.avg(F.octet_length("t"))).head()[0] or 1.0
    keep = max(1, min(most, int(max_bytes / max(mean, 1.0))))
    chosen = keyed.select("i", "h").distinct().orderBy(F.xxhash64("i"), "i", "h").limit(keep).select(
        F.col("i").alias("ci"), F.col("h").alias("ch"))  # at most keep narrow rows
    rows = keyed.join(F.broadcast(chosen), F.col("i").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch")))
    one = rows.groupBy("i", "h").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "i", "h").select("t")
    return one.toArrow().combine_chunks().to_batches()[0]


def annotate(
    docs: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], result: T.StructType, carry: Sequence[str],
    text: str = "text", inputs: Sequence[str] = (), limit: int = SLICE_BYTES,
) -> DataFrame:
    """One output row for each input row: the carried columns and what fn returns for a slice of rows.

    A carried column that has the name of a result column is left out (the result wins). No shuffle.
    """
    ship_package(docs.sparkSession)
    carry = [c for c in carry if c not in result.fieldNames()]
    fields = [docs.schema[c] for c in carry] + list(result.fields)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = to_arrow_schema(schema)
    need = list(dict.fromkeys([*carry, text, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, limit):
                made = fn(piece)
                arrays = [piece.column(piece.schema.get_field_index(c)) for c in carry]
                arrays += [made[f] for f in result.fieldNames()]
                yield pa.RecordBatch.from_arrays(
                    [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow
                )

    return docs.select(*need).mapInArrow(run, schema)
