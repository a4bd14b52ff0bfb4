"""Graph-pattern analytics over quad tables, expressed as Spark DataFrames."""
