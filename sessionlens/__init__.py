"""sessionlens: analytics over agent session logs, as Spark DataFrame functions."""
