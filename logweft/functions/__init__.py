"""Column expressions: times of day, log lines, labels."""
