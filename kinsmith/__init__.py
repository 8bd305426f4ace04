"""Record-linkage analytics as composable Spark DataFrame operators."""
