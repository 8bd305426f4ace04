"""Tables in and out: verbatim TSV, parquet, contracts, row numbers, configuration, artifacts."""
