"""Sources and sinks: the sales adapter over the driver tables, CSV / JSON /
Parquet readers and writers, page extraction and incremental landing."""
