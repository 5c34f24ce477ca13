"""Operational-memory analytics expressed as Spark DataFrame plans."""
