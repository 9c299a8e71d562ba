"""Sources and sinks: test-table readers, the planted fixture, CSV/parquet IO."""
