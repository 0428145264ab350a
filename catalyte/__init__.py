"""Catalogue search, enrichment analytics and corpus preparation on Spark."""
