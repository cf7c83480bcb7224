"""gridloom: hourly series, history tables and marts on Spark's DataFrame API."""
