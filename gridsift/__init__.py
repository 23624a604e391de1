"""Judge, clean and deliver untyped tables at scale, on Spark DataFrames."""

from gridsift.operators.clean import clean_tables
from gridsift.operators.confidence import accepted, confidence, profile
from gridsift.operators.grid import to_cells, to_grid, union_tables
from gridsift.settings import OutputSettings, RetrySettings, ScoreSettings, WatchSettings

__all__ = [
    "OutputSettings", "RetrySettings", "ScoreSettings", "WatchSettings", "accepted", "clean_tables",
    "confidence", "profile", "to_cells", "to_grid", "union_tables",
]
