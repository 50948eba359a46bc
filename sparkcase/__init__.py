"""Case analytics for financial-crime data, as Spark DataFrame jobs."""
