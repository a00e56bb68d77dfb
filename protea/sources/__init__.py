"""Scans and sinks: FASTA, TSV/CSV tables, hit tables, Parquet, and writers."""
