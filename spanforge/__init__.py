"""Spark-native detection, resolution, masking, audit and evaluation of personal data in document collections."""
