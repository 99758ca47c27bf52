"""lectern: retrieval and text-data analytics on PySpark DataFrames."""
