"""Typed errors."""


class OrreryError(Exception):
    """Base of all errors that this library raises on purpose."""


class InvalidHyperparameterError(OrreryError, ValueError):
    """A specification has a parameter outside its domain."""


class SchemaMismatchError(OrreryError):
    """A column that is needed is absent, or lengths disagree."""


class UnsupportedDataError(OrreryError):
    """The data cannot be handled: missing or infinite values, too many rows for a quadratic method, unknown levels."""


class UnsupportedBackendError(OrreryError):
    """A backend other than Spark was asked for."""


class ConvergenceError(OrreryError):
    """An iteration did not converge where that is required."""


class NumericalFailureError(OrreryError):
    """A numerical step failed, such as a factorisation."""


class PersistenceVersionError(OrreryError):
    """A saved model has an unknown version or was damaged."""


class GraphValidationError(OrreryError):
    """A pipeline is not well-formed."""


class LeakageError(OrreryError):
    """A pipeline would let a target reach a transformer that must not see it."""
