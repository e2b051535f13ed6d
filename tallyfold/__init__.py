"""Portfolio and market-data analytics as DataFrame-to-DataFrame operators on Spark."""
