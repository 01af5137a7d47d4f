"""Spark-first document processing."""
