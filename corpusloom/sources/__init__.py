"""Readers and writers: parquet, JSONL logs, SQLite, HTML pages, CSV and Markdown."""
