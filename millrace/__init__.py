"""Millrace: document retrieval, clean-up and analytics as Spark DataFrame operators."""
