"""Topic modelling of text corpora on Spark DataFrames."""
