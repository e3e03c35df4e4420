"""Catalog-scale song timelines, spectral frames and artifact audits on Spark DataFrames."""
