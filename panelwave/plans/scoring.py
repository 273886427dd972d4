"""The daily scoring run as one plan over a dense panel, with written cut points between window-heavy stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.operators import cascades, quality
from panelwave.operators import xsection as xs
from panelwave.operators.components import components
from panelwave.operators.features import compute_features
from panelwave.operators.score import score
from panelwave.operators.sizing import materialize
from panelwave.operators.standardize import standardize
from panelwave.operators.state import state
from panelwave.operators.themes import aggregate_themes


def gate(bars: DataFrame, report: DataFrame, benchmarks: Sequence[str]) -> DataFrame:
    """Bars of entities that passed the firewall, plus the benchmarks."""
    ok = quality.passing(report)
    return bars.where(F.col("entity").isin(*benchmarks)).unionByName(
        bars.where(~F.col("entity").isin(*benchmarks)).join(ok, "entity", "left_semi"))


def feature_stage(panel: DataFrame, benchmarks: Sequence[str], bound: xs.Bound, keep: Sequence[str] = ()) -> DataFrame:
    """Feature panel, written once: every later stage reads it several times."""
    return materialize(compute_features(panel, benchmarks, bound, keep))


def score_stage(features: DataFrame, bound: xs.Bound) -> DataFrame:
    """features -> z -> components -> state -> score -> tier -> setup, all on one row per (entity, date)."""
    z = materialize(standardize(features, bound=bound))
    df = state(components(z, bound))
    return cascades.setups(cascades.leadership(score(df, bound)), bound)


def theme_stage(scored: DataFrame, bars: DataFrame, members: DataFrame, benchmark: str, bound: xs.Bound) -> DataFrame:
    return aggregate_themes(scored, bars, members, bars.where(F.col("entity") == benchmark), bound)
