"""Panel scoring on Spark: bars, rolling windows, cross-sections, scores, labels, rollups, evaluation."""
