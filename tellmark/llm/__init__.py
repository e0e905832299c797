"""Operators for preparing training data: language, duplicates, captures, neighbours, tokens, packing.

Nothing outside this package imports it. Every operator takes and returns DataFrames and reads
only the columns it names, so further columns of any name do no harm.
"""
