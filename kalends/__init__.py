"""Calendar analytics on Spark: recurrence, resolution, deduplication and read models as DataFrame functions."""
