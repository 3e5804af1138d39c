"""A Spark-native engine for graphs of overlapping DNA segments observed across samples."""
