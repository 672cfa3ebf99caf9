"""Sources: the file tree as a data source, and readers that turn file bytes into typed relations."""
