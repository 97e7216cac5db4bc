"""Table-level operators: every function maps DataFrame(s) -> DataFrame."""
