"""Consumers of the log: batches, workers, and the streaming source."""
