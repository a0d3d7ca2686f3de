"""Schema-checked readers."""
