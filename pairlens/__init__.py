"""Paired-score and generation-audit analytics on Spark DataFrames.

Every operator takes DataFrames and column names and returns a lazy DataFrame
(or a Column, in :mod:`pairlens.functions`).
"""
