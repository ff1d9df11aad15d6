"""Spark-native analytics over corpora of small labelled property graphs."""
