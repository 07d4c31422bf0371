"""Spark-native k-mer analytics, read correction and corpus preparation."""
