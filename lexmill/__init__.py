"""Spark-native evaluation of text and transcript data at corpus scale."""
