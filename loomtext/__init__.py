"""loomtext: corpus-stylometry and training-data preparation on Spark DataFrames."""
