"""recscope: queries over API-trace records, written as Spark DataFrames."""
