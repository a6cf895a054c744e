"""Table-level operators: each takes DataFrames and returns DataFrames, lazily unless it says otherwise."""
