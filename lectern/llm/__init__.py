"""Operators of a training-data pipeline over the tables documents, pages, benchmark and labels.

Nothing outside this subpackage imports it. Each module holds one operator with its own interface; ``queries`` holds the
thin registered queries, which read whole tables and apply the operators with production parameters.
"""
