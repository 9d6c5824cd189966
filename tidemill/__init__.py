"""Time-series monitoring and text preparation as Spark DataFrame operators."""
