"""strata: a lakehouse and analytics engine on Spark DataFrames."""
