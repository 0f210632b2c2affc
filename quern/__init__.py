"""Quern: relational operators over columnar integer tables, on Spark."""
