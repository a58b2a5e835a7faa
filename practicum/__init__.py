"""Spark-native learning analytics: practice histories, sparse designs, logistic models."""
