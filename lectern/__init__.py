"""A Spark-first engine that turns trees of documents into clean, indexed Markdown."""
