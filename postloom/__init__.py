"""Spark-native analytics over product-feedback signals."""
