"""Photo-shoot analytics on Spark: catalogues, bursts, recipes and pixels as DataFrames."""
