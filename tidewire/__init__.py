"""Spark-native news-and-price signal pipeline.

Every operator takes and returns a DataFrame; nothing whole passes through the
driver, one task or one group.  See README.md for the map from capability to
module.
"""
