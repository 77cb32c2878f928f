"""tracequill: evidence tables, identities, intervals and catalogs on Spark DataFrames."""
