"""loam: a Spark-native knowledge-base and retrieval engine (DataFrame in, DataFrame out)."""
