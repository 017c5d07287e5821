"""A Spark-native engine that searches messy text and returns exact source spans."""
