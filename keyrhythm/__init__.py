"""Spark-native behavioural features and classification from timed event logs."""
