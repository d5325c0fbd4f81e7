"""Streaming.

The workload this library re-expresses has no streams: no watermark, window,
session, state or late data. Monthly inputs arrive as files and are read as
one batch (``wreath.sources.io.read_table`` with a glob or list of paths).
This package is kept empty on purpose.
"""
