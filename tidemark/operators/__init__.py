"""DataFrame operators: relational, windowed, vector, signal and execution."""
