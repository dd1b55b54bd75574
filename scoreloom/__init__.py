"""Assessment analytics on Spark: wide raw records in, star schema, marts and cohort answers out."""
