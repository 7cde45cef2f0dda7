"""Retail inventory and sales analytics as PySpark DataFrame operators."""
