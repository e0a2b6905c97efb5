"""Training and wellness analytics over per-second activity records, as Spark DataFrame jobs."""
