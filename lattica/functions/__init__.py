"""Column functions and hooks for user-supplied models."""
