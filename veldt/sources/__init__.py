"""Where tables come from and are kept: attached DataFrames, versioned Parquet, the catalog."""
