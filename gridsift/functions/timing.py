"""Retry timing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsift.settings import RetrySettings


def backoff(attempt: Column, retry: RetrySettings = RetrySettings()) -> Column:
    """Seconds to wait: the plain delay first, then growing up to the limit."""
    grown = F.lit(retry.delay) * F.pow(F.lit(retry.backoff_factor), attempt)
    return F.when(attempt <= 0, F.lit(retry.delay)).otherwise(F.least(grown, F.lit(retry.max_delay)))
