"""Visitor and campaign analytics as Spark DataFrame jobs."""
