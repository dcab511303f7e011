"""Repair of change-data-capture streams that have holes in them, on Spark."""
