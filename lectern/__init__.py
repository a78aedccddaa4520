"""Spark-first analytics over scholarly article corpora."""
