"""Whole plans: the batch run from tree to index, and the registered queries with their SQL."""
