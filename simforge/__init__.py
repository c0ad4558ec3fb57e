"""simforge: Spark-native source-code similarity analytics."""
