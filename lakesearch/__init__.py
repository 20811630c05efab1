"""Spark jobs for document knowledge bases."""
