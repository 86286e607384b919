"""quern: analytics and modelling on Spark DataFrames."""
