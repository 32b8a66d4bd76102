"""Front end and planner: text to nodes, macros, checks, dependencies, and lowering to DataFrames."""
