"""Evidence-graph and corpus analytics expressed in PySpark DataFrames."""
