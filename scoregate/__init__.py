"""Spark-native evaluation of anomaly scorers: DataFrame in, DataFrame out."""
