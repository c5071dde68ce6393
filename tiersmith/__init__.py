"""Catalogue analytics on Spark: cleaning, features, imbalance-aware models, scoring."""
