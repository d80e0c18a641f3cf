"""weftline: work-graph analytics as composable Spark DataFrame operators."""
