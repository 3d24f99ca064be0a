"""Memory analytics on Spark: DataFrame-to-DataFrame operators over all users at once."""
