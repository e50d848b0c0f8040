"""Tideline: timed text streams reconciled, scored and rendered with Spark."""
