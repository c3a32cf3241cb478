"""lodestream: DataFrame-first analytics on Spark."""
