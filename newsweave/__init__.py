"""News recommendation analytics written as Spark DataFrame operators."""
