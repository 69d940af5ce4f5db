"""millrace: a Spark-first library of analytical, point-in-time and evaluation operators."""
