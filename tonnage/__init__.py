"""Tonnage: manufacturing analytics expressed as Spark DataFrame jobs."""
