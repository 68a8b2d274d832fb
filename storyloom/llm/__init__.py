"""Operators for training-data pipelines: cleaning, de-duplication, scoring, mixing, tokenising.

Nothing outside this folder imports it.
"""
