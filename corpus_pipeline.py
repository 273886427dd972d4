"""Corpus cleaning in five stages; each takes (spark, docs, folder of tables) and returns what its successor reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwave.llm import decontaminate as decon
from panelwave.llm import minhash, pieces, suffixdedup, toxicity
from panelwave.operators.sizing import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, carry=docs.columns, prefix="__tox_")
    return scored.filter("__tox_predicted = 0").select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of smallest id, and of texts that share it one.

    A row is known by id and text, so rows of one id, or without one, have their own decisions. Rows without words are
    groups of their own; of rows that repeat id and text one stays.
    """
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    found = minhash.groups(rows, carry=["__hash"]).filter("kept")
    alone = F.when(F.col("component_key").isNull(), F.col("__hash"))
    kept = found.groupBy("doc_id", "component_key", alone.alias("__alone")).agg(F.min("__hash").alias("__chosen"))
    kept = kept.select(F.col("doc_id").alias("__kept"), "__chosen")
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__chosen")), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy("__hash"))
    return rows.withColumn("__row", first).filter("__row = 1").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings; characters that a cut goes through go too, as do texts of which nothing is left."""
    found = suffixdedup.remove_repeats(docs, carry=docs.columns, prefix="__rep_")
    changed = F.col("__rep_n_removed") > 0
    rows = found.withColumn("text", F.when(changed, F.col("__rep_left")).otherwise(F.col("text")))
    rows = rows.filter(~changed | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decon.decontaminate(docs, bench, carry=docs.columns, prefix="__dec_")
    return found.filter("not __dec_contaminated").select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece numbers of their texts."""
    return pieces.encode(docs, pieces.default_model(), carry=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_group),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: the trained scorer and the piece model cannot be stated in SQL; see tests/llm for the brute-force comparison
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
