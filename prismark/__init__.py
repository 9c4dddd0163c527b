"""prismark: curation of masked image observations, their vectors and their reports, on PySpark DataFrames."""
