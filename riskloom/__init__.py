"""Auditing and evaluating tabular risk studies on Spark."""
