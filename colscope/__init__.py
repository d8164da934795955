"""Data profiling, cleaning and feature preparation as Spark DataFrame expressions."""
