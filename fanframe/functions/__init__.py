"""Adapters between user functions and Spark."""
