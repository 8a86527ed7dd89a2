"""What the library raises on the driver; failures of single rows are columns (error, status) instead."""


class VerdictError(Exception):
    """Base of all errors of the library."""


class CapabilityError(VerdictError):
    """A model was asked for something that it doesn't offer."""


class RegistryError(VerdictError, ValueError):
    """A name isn't registered, or is taken."""


class MissingExtraError(VerdictError, ImportError):
    """An optional package isn't there."""

    def __init__(self, package: str):
        super().__init__(f"the package {package!r} is needed for this")
        self.package = package


class ModelError(VerdictError):
    """A model failed."""


class ModelTimeoutError(ModelError):
    """A model took longer than it may."""


class MetricError(VerdictError):
    """A score could not be computed."""


class SampleSkippedError(VerdictError):
    """A sample was left out."""
