"""Procurement-integrity analytics as Spark DataFrame operators."""
