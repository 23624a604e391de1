"""Shared plan shapes: checked broadcasts and ordered scans of hot groups."""

from gridsift.plans.joins import join_small
from gridsift.plans.ordered import next_value, number_since, number_within, running_max_before

__all__ = ["join_small", "next_value", "number_since", "number_within", "running_max_before"]
