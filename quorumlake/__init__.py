"""Civic-records analytics as Spark DataFrame operators."""
