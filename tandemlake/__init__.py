"""Analytics of long tandem repeats in DNA on Spark DataFrames."""
