"""Tessera: governed document knowledge and corpus preparation as Spark DataFrame jobs."""
