"""Query descriptions turned into DataFrames."""
