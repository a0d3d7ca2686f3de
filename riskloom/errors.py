"""The one error type raised by validating operators."""


class ValidationError(ValueError):
    """A table, column, key, label or parameter breaks a stated contract."""
