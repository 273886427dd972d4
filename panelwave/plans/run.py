"""The connected daily run: gate, features, score, themes, checks, and a publish that shows all tables at once or none."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.operators import bars as B
from panelwave.operators import quality, reliability, views
from panelwave.operators import xsection as xs
from panelwave.plans import scoring
from panelwave.sources.readers import read_table
from panelwave.sources.sinks import write_table

TABLES = ("bars", "quality", "features", "scored", "themes", "findings", "anomalies")
MANIFEST = "run_id string, sequence long, table string, path string, n_rows long, latest date"


def score_run(bars: DataFrame, calendar: DataFrame, members: DataFrame, benchmarks: Sequence[str], bound: xs.Bound,
              limits: quality.Limits = quality.Limits(), change: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The seven tables of one run. ``change`` is applied to the scored rows (a hook for overrides)."""
    spark = bars.sparkSession
    own = bars.where(~F.col("entity").isin(*benchmarks))
    report = quality.firewall(own, lim=limits)
    gated = scoring.gate(bars, report, benchmarks)
    features = scoring.feature_stage(B.densify(gated, calendar), benchmarks, bound)
    scored = scoring.score_stage(features, bound)
    scored = scoring.materialize(scored if change is None else change(scored))
    themes = scoring.materialize(scoring.theme_stage(scored, gated, members, benchmarks[0], bound))
    rules = spark.createDataFrame(list(reliability.RANGE_RULES), reliability.RULE_SCHEMA)
    findings = reliability.all_findings(views.latest(scored), views.latest(themes), members, rules)
    return dict(zip(TABLES, (gated, report, features, scored, themes, findings, reliability.anomalies(scored))))


def publish(spark: SparkSession, root: str, run_id: str, sequence: int, tables: Mapping[str, DataFrame],
            may_fail: frozenset[str] = frozenset()) -> bool:
    """Write the tables of a run under its id; show them only if its findings do not fail.

    Readers find tables through the manifest alone. It is one file, written after all tables and moved into place when its
    job commits, so readers see the whole run or the one before it. A run that fails, or stops half-way, changes nothing
    for them, and may be written again under the same id. Checks in ``may_fail`` do not stop a run.
    """
    for name, df in tables.items():
        write_table(df, f"{root}/runs/{run_id}/{name}")
    stored = {name: read_table(spark, f"{root}/runs/{run_id}/{name}", df.schema) for name, df in tables.items()}
    outcome = reliability.verdict(stored["findings"].where(~F.col("check").isin(*may_fail))).head().verdict
    if outcome == "FAIL":
        return False
    rows = []
    for name, df in stored.items():
        last = F.max("date") if "date" in df.columns else F.lit(None).cast("date")
        r = df.agg(F.count("*").alias("n"), last.alias("latest")).head()  # one row a table
        rows.append((run_id, sequence, name, f"{root}/runs/{run_id}/{name}", r.n, r.latest))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifest/run={run_id}")
    return True


def published(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of the last good run; none before the first."""
    try:
        every = spark.read.schema(MANIFEST).json(f"{root}/manifest")
        every.head(1)
    except Exception as e:  # nothing has been published yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return every.join(F.broadcast(every.agg(F.max("sequence").alias("sequence"))), "sequence", "left_semi")  # one row


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the last good run."""
    (row,) = published(spark, root).where(F.col("table") == table).collect()  # one row
    return spark.read.parquet(row.path)


def archive(spark: SparkSession, root: str) -> None:
    """Latest-date slice of all seven published tables under snapshot_date; only that date's folders are replaced."""
    rows = published(spark, root).collect()  # one row a table
    day = max(r.latest for r in rows if r.latest is not None)
    for r in rows:
        df = spark.read.parquet(r.path)
        x = (views.latest(df) if "date" in df.columns else df).withColumn("snapshot_date", F.lit(day))
        (x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date")
         .parquet(f"{root}/archive/{r.table}"))


def read_archive(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The dated archive of a table of the last good run; a table whose slices had no rows reads as empty."""
    schema = T.StructType([*read_published(spark, root, table).schema.fields, T.StructField("snapshot_date", T.DateType())])
    return read_table(spark, f"{root}/archive/{table}", schema)
