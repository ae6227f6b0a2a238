"""Training-data operators: ten corpus-scale components on DataFrames."""
