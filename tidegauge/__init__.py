"""tidegauge: market and thesis analytics as Spark DataFrame operators."""
