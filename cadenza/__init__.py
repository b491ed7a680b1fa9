"""Catalogue analytics on Spark: declarative read models, matching, similarity and recommendation."""
