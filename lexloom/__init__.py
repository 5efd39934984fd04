"""Document search and corpus intelligence on PySpark DataFrames."""
