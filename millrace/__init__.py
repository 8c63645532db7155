"""millrace: data-wrangling flows on Spark DataFrames."""
