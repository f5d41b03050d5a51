"""Operators of a training-data pipeline. Nothing else in siftgram imports this."""
