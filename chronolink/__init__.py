"""Causal discovery on multivariate and panel time series, on Spark."""
