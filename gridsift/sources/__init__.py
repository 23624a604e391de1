"""Inputs and outputs: file inventory, delimited text, workbooks, delivery, run log."""
