"""Operators of a training-data pipeline: cleaning, scoring, near duplicates, packing, search.

Every operator takes DataFrames with named columns and leaves other columns alone; the
queries over the test tables are in ``loomset.llm.queries``.
"""
