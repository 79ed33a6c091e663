"""Set-oriented operators: each takes DataFrames and returns one."""
