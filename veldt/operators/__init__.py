"""SELECT, changes of rows, and constraints, as DataFrames."""
