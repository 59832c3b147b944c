"""Evidence operators on DataFrames."""
