"""Exceptions of the library."""


class LaminaError(Exception):
    """Base of all errors raised here."""


class QueryError(LaminaError):
    """A query that names unknown columns or can't be bound."""


class FilterSyntaxError(QueryError, ValueError):
    """Text that is no filter expression."""


class TimeTravelSyntaxError(QueryError, ValueError):
    """A malformed AS OF clause."""


class ConflictError(LaminaError):
    """A transaction that can't commit beside others."""


class DuplicateKeyError(LaminaError, ValueError):
    """An insert of a key that is there."""


class KeyNotFoundError(LaminaError, KeyError):
    """An update or delete of a key that isn't visible."""


class InvalidParameterError(LaminaError, ValueError):
    """An argument outside its domain."""


class HistoryUnavailableError(LaminaError):
    """Commit history that a read needs is missing."""
