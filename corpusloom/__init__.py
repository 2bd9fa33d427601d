"""Corpus tables on Spark: captured content in, clean versioned tables out."""
