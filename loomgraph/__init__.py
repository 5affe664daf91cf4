"""Code-graph analytics and large-corpus preparation on PySpark."""
