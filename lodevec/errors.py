"""Typed errors. Parameters are checked on the driver before a job starts; bad data surfaces in the job."""


class EngineError(Exception):
    """Base of all errors of this package."""


class ValidationError(EngineError, ValueError):
    """A parameter or an input is invalid."""


class DimensionMismatchError(ValidationError):
    """Two vectors that belong together have different lengths."""


class ProviderError(EngineError):
    """An embedding source failed; ``status_code`` is that of its answer, if there was one."""

    def __init__(self, message: str, provider: str, status_code: int | None = None):
        super().__init__(message)
        self.provider, self.status_code = provider, status_code


class ModelNotFoundError(EngineError):
    """A model's name isn't registered."""
