"""Scripts: text to steps, and steps to DataFrames."""
