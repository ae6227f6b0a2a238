"""Spark-first analytics over listening histories, concerts, setlists and releases."""
