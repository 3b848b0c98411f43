"""Errors raised before any Spark job starts."""


class QuernisError(ValueError):
    """Base of the library's own errors."""


class BindError(QuernisError):
    """A name or a type that the plan cannot use."""
