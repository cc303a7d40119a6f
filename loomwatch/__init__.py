"""Labelled-event corpora and classifier evaluation on Spark."""
