"""Wide-column analytics on PySpark: a CQL-style engine over DataFrames."""
