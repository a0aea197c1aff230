"""Code-corpus and activity-log analytics on PySpark DataFrames."""
