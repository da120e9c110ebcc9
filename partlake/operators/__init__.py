"""Planning operators as functions from DataFrames to DataFrames. ``as_of`` and windows are always arguments."""
