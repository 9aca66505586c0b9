"""Labelled symbol sequences on Spark: ingest, model, score, evaluate, check."""
