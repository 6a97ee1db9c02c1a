"""Document-evidence analytics on PySpark: plans, folds, search, diff and retention as DataFrame jobs."""
