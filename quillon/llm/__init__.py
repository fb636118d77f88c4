"""Training-data operators: deduplication, token files, quality, sharding, mixing and packing.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames; the thin
queries of :mod:`quillon.llm.queries` apply them to whole tables.
"""
