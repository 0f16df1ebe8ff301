"""fanframe: user-defined functions over Spark tables with pandas semantics."""
