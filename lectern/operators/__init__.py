"""Relational operators of the document engine: DataFrame in, DataFrame out, explicit schemas, no driver-side loops."""
