"""A Spark-native engine for retrieval, memory and knowledge analytics over DataFrames."""
