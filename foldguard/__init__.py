"""foldguard: leakage-aware analysis of wide, messy record tables on Spark.

Every public function takes DataFrames (or Columns) and column names and returns
DataFrames (or Columns).  Nothing here needs the rows of a table on the driver.
"""

__version__ = "0.1.0"
