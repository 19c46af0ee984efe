"""Operators for building training corpora, and the queries that apply them.

Nothing outside this package imports it; it may use the library's general
helpers (session, scratch folder).  Every operator is a function from
DataFrames to DataFrames and names its own columns, so input tables may carry
any further columns.
"""
