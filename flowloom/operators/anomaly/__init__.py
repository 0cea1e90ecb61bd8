"""Outlier models on user features."""
