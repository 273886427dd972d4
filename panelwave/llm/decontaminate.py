"""Benchmark decontamination: an FM-index over each shard of training text answers all test phrases at once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.llm.fmindex import FMIndex
from panelwave.llm.textvec import ALNUM, Texts, annotate, counts_by
from panelwave.operators.sizing import materialize

WINDOW_WORDS = 13
SHARD_BYTES = 1 << 20
#: a larger benchmark is broadcast in parts of about this many bytes, one pass over the documents for each
PART_BYTES = 32 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN)),
])


@dataclass
class Phrases:
    """Distinct windows of one benchmark part as rows of word numbers, and the items that have each of them."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    windows: np.ndarray  # right-aligned word numbers
    lengths: np.ndarray
    item_from: np.ndarray  # items of window w: item_of[item_from[w]:item_from[w + 1]]
    item_of: np.ndarray
    names: list[str]  # sorted as strings


def phrases(rows: Sequence[tuple[object, str | None]], width: int = WINDOW_WORDS) -> Phrases:
    names = sorted({str(i) for i, _ in rows if i is not None})
    number = {name: k for k, name in enumerate(names)}
    texts = Texts(pa.array([t for i, t in rows if i is not None], pa.string()))
    items = np.array([number[str(i)] for i, _ in rows if i is not None], np.int64)
    starts, ends, owner = texts.words(ALNUM)
    hashes = texts.hashes(starts, ends)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes) + 1
    found: dict[bytes, tuple[np.ndarray, set[int]]] = {}
    bounds = np.concatenate([[0], np.cumsum(counts_by(owner, texts.n))])
    for k in range(texts.n):
        own = numbers[bounds[k] : bounds[k + 1]]
        for i in range(max(1, len(own) - width + 1) if len(own) else 0):
            window = own[i : i + width]
            found.setdefault(window.tobytes(), (window, set()))[1].add(int(items[k]))
    windows = np.zeros((len(found), width), np.int64)
    lengths = np.zeros(len(found), np.int64)
    item_lists = []
    for w, (window, who) in enumerate(found.values()):
        windows[w, width - len(window) :] = window
        lengths[w] = len(window)
        item_lists.append(sorted(who))
    item_from = np.concatenate([[0], np.cumsum([len(x) for x in item_lists])]).astype(np.int64)
    item_of = np.array([i for x in item_lists for i in x], np.int64)
    return Phrases(vocabulary, windows, lengths, item_from, item_of, names)


def occurrences(numbers: np.ndarray, owner: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in the shard; occurrences stay inside one text.

    Words outside the benchmark's vocabulary cannot be part of one: they only cut the text into runs, and a run
    shorter than the shortest window is left out of the index.
    """
    none = np.zeros(0, np.int64)
    known = numbers > 0
    if not len(p.lengths) or not known.any():
        return none, none
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
    run = np.cumsum(begins) - 1
    size = np.bincount(run[known])
    use = known.copy()
    use[known] = size[run[known]] >= p.lengths.min()
    words = np.flatnonzero(use)
    if not len(words):
        return none, none
    heads = np.flatnonzero(begins[words])
    # one end symbol before each run and one after the last
    at = np.arange(len(words)) + np.cumsum(begins[words])
    symbols = np.zeros(len(words) + len(heads) + 1, np.int64)
    symbols[at] = numbers[words]
    back = np.full(len(symbols), -1, np.int64)
    back[at] = words
    index = FMIndex(symbols, len(p.vocabulary) + 1)
    lo, hi = index.search(p.windows, p.lengths)
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return back[index.locate(rows)], window


def shard_hits(texts: Texts, p: Phrases) -> dict[str, list]:
    starts, ends, owner = texts.words(ALNUM)
    n_words = counts_by(owner, texts.n)
    out = {"n_words": n_words, "n_hit": np.zeros(texts.n, np.int64), "items": [[]] * texts.n, "spans": [[]] * texts.n}
    if not len(starts) or not len(p.vocabulary):
        return out
    hashes = texts.hashes(starts, ends)
    place = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    numbers = np.where(p.vocabulary[place] == hashes, place + 1, 0)
    first, window = occurrences(numbers, owner, p)
    if not len(first):
        return out
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + p.lengths[window], -1)
    hit = np.cumsum(change[:-1]) > 0
    out["n_hit"] = np.bincount(owner[hit], minlength=texts.n)
    begins = hit.copy()
    begins[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    stops = hit.copy()
    stops[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    spans: dict[int, list] = {}
    for a, b in zip(np.flatnonzero(begins), np.flatnonzero(stops)):
        k = int(owner[a])
        spans.setdefault(k, []).append(
            {"start": int(starts[a] - texts.offsets[k]), "end": int(ends[b] - texts.offsets[k])}
        )
    pairs = np.unique(owner[first] * len(p.lengths) + window)
    items: dict[int, set[int]] = {}
    for k, w in zip((pairs // len(p.lengths)).tolist(), (pairs % len(p.lengths)).tolist()):
        items.setdefault(k, set()).update(p.item_of[p.item_from[w] : p.item_from[w + 1]].tolist())
    out["items"] = [[p.names[i] for i in sorted(items[k])] if k in items else [] for k in range(texts.n)]
    out["spans"] = [spans.get(k, []) for k in range(texts.n)]
    return out


def _merge_spans(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _scan(docs: DataFrame, spark: SparkSession, p: Phrases, carry: Sequence[str], prefix: str, text: str,
          earlier: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast(p)
    result = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in RESULT])
    names = [f"{prefix}items", f"{prefix}spans"]

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = Texts(batch.column(batch.schema.get_field_index(text)))
        got = shard_hits(texts, shared.value)
        if earlier:  # parts of a large benchmark: join with what the parts before have found
            items, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
            got["items"] = [sorted({*x, *y}) for x, y in zip(items, got["items"])]
            got["spans"] = [_merge_spans(x, y) for x, y in zip(spans, got["spans"])]
            starts, _, owner = texts.words(ALNUM)
            local = starts - texts.offsets[owner]
            bounds = np.concatenate([[0], np.cumsum(got["n_words"])])
            got["n_hit"] = np.array([
                sum(int(np.searchsorted(local[bounds[k]:bounds[k + 1]], s["end"])
                        - np.searchsorted(local[bounds[k]:bounds[k + 1]], s["start"])) for s in spans_k)
                for k, spans_k in enumerate(got["spans"])
            ], np.int64)
        return {
            prefix + "n_words": pa.array(got["n_words"]), prefix + "n_hit": pa.array(got["n_hit"], pa.int64()),
            prefix + "items": pa.array(got["items"], pa.list_(pa.string())),
            prefix + "spans": pa.array(got["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }

    return annotate(docs, fn, result, carry, text, names if earlier else (), SHARD_BYTES)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, carry: Sequence[str] = ("doc_id",), prefix: str = "", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Carried columns with n_words, n_hit, items, spans (byte ranges of merged hits) and contaminated.

    Words are ``[0-9a-z]`` and bytes from 0x80 on after lower-casing A-Z. An item's windows are its runs of width
    words; an item of fewer words is one window, an item without words has none. A document is contaminated when
    20 * n_hit >= n_words > 0 and n_hit > 0. Documents are read once per benchmark part and never shuffled.

    Null or empty text: no words, not contaminated. Null item_id: the item is left out. Repeated documents or items
    are judged alike; an empty benchmark hits nothing; a carried column named like a result column is dropped.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null")
    size = bench.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    parts = int(size // part_bytes) + 1
    out = docs
    for k in range(parts):
        own = bench if parts == 1 else bench.filter(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(parts)) == k)
        p = phrases([tuple(r) for r in own.collect()], width)  # at most about part_bytes
        last = k == parts - 1
        out = _scan(out, spark, p, list(dict.fromkeys([*carry, *([] if last else [text])])), prefix, text, k > 0)
        if not last:
            out = materialize(out)
    hit, words = F.col(prefix + "n_hit"), F.col(prefix + "n_words")
    return out.withColumn(prefix + "contaminated", (hit > 0) & (20 * hit >= words))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
        FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.phrase = win.phrase AND dw.n = win.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
