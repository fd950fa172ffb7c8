"""A Spark-native engine for searching, structuring and curating text and source code."""
