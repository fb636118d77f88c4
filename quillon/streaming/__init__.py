"""Incremental runs: micro-batches that flush, resume and accumulate."""
