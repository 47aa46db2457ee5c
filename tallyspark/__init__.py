"""Sales data quality and statistics as Spark DataFrame operators."""
