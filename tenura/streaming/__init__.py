"""The parts that also run on streaming DataFrames."""
