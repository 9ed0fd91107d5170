"""Streams: the analytics read whole files, so no streaming operator is needed; range metrics and
windows are plain DataFrame expressions and accept batches of a stream through ``foreachBatch``."""
