"""Errors of the library."""


class ConfigError(ValueError):
    """A setting is out of its domain."""


class ProtocolError(ValueError):
    """A value is not a valid envelope."""


class LogError(RuntimeError):
    """The segmented log is damaged or was used wrongly."""
