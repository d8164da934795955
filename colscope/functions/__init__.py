"""Types and column functions."""
