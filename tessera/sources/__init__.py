"""Readers of directories of files, and the Parquet store. One job reads many files; files are the unit of parallelism."""
