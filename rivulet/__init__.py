"""rivulet: step-by-step dataflow scripts as Spark DataFrames, in batch or as structured streams."""
