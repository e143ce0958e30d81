"""turnloom: dyadic turn and signal analytics on Spark DataFrames."""
