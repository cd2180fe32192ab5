"""Driving-scenario analytics as lazy Spark DataFrame transformations."""
