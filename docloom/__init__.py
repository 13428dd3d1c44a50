"""docloom: document-intelligence operators for PySpark.

Every operator takes DataFrames (or Columns) and returns a lazy DataFrame (or
Column); Catalyst and AQE choose the physical plan.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming", "catalog"]
