"""Spark-native analytics for time-stamped transcripts and speaker vectors."""
