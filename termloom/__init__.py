"""Spark-native compiler of business models and taxonomies into a governed graph of statements."""
