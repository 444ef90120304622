"""solframe: photovoltaic reliability analytics as composable Spark DataFrame operators."""
