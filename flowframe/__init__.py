"""Declarative data flows and the analytics built on them, on Spark DataFrames."""
