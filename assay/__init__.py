"""Assay: a Spark-native deterministic data-quality and corpus analytics engine."""
