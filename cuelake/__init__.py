"""Timed-text analytics on Spark: words to cues, gates, reading speed, batches, statistics."""
