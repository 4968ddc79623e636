"""Document-erasure analytics on Spark: find, redact and verify, set at a time."""
