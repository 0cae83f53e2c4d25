"""loomwork: a Spark-first engine for preparing, auditing and scoring language-model training data."""
