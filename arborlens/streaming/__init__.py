"""Streams: lines, batches, metric windows."""
