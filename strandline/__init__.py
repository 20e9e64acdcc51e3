"""Spark-native analytics over long sequences: k-mers, overlaps, intervals, layouts, consensus."""
