"""Event, sensor and place analytics as composable Spark DataFrame operators."""
