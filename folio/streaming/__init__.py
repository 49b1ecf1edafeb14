"""Structured Streaming forms of the job queue, the solver's chunks and the page cache."""
