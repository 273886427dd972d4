"""The pipeline's stages against brute force, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
import pytest

from panelwave.llm import pieces, toxicity
from tests.llm.test_corpus_ops import hits_by_hand, near_by_hand, repeats_by_hand

DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, DIR)
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    rows = rows_of(clean)
    assert {d for d, _ in rows} == {d for d, _ in rows_of(docs)} - bad and clean.columns == docs.columns

    one = corpus_pipeline.keep_one_of_group(spark, clean, DIR)
    keep = {d for d, _, c in near_by_hand(rows) if d == c}
    rows = [r for r in rows if r[0] in keep]
    assert rows_of(one) == rows and one.columns == docs.columns

    cut = corpus_pipeline.cut_repeats(spark, one, DIR)
    full = dict(rows)
    rows = sorted((d, full[d] if not gone else left.decode("utf-8", "ignore")) for d, _, gone, _, left in repeats_by_hand(rows)
                  if not gone or left.decode("utf-8", "ignore"))
    assert rows_of(cut) == rows and cut.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cut.collect() if full[r.doc_id] != r.text)

    pure = corpus_pipeline.drop_contaminated(spark, cut, DIR)
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, _, _, _, hit in hits_by_hand(rows, bench) if hit}
    rows = [r for r in rows if r[0] not in dirty]
    assert rows_of(pure) == rows and pure.columns == docs.columns

    last = corpus_pipeline.to_pieces(spark, pure, DIR).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert sorted((r.doc_id, r.text, r.ids) for r in last) == [(d, t, library.encode(t)) for d, t in rows]
    got = corpus_pipeline.run(spark, DIR).select("doc_id", "ids").collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(d, library.encode(t)) for d, t in rows]


def test_one_of_group_by_id_and_text(spark):
    """Repeated and null ids: every row is judged by its own text; extra columns are kept, also those named like results."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:59] + ["other"])
    far, alone = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [
        (3, " ".join(base), 1), (5, near, 2), (5, far, 3), (5, far, 4),  # id 5: a near copy of 3, and a text of its own twice
        (None, near, 5), (None, alone, 6), (None, alone + " more", 7), (None, "", 8), (None, "", 9), (None, " ", 10), (None, None, 11),
        (7, far + " end", 12),  # near copy of a text of id 5
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_group(spark, docs, DIR).collect()]
    by = sorted(got, key=str)
    assert len(by) == len(set(by)) == 6
    assert (3, " ".join(base)) in by and (5, far) in by and {t for d, t in by if d is None and (t or "").strip() == ""} == {"", " ", None}
    assert sum(t in (alone, alone + " more") for _, t in by) == 1 and all(d in (3, 5, None) for d, _ in by)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
