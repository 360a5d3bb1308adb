"""Whole plans: options, the batch pipeline, the command line, the query catalogue."""
