"""Tables, feeds and saved pages as DataFrames."""
