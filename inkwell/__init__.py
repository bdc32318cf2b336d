"""Analytics on handwriting and ink-evaluation data, native to PySpark."""
