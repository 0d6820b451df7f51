"""Supply, trade and reliance accounting as PySpark DataFrame jobs."""
