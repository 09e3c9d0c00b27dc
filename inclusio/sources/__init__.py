"""Sources and sinks: the survey view over the driver tables, CSV/Parquet I/O, artifacts."""
