"""Structured Streaming forms of the bar builder and of batch scoring.

The reference has no streams; its broker feed and its "score the new
petitions" step are the natural streaming cases, so these reuse the batch
operators on micro-batches.
"""
