"""Errors of the library, all below one root."""


class TallyfoldError(Exception):
    """Root of the library's errors."""


class ContractError(TallyfoldError):
    """Rows break a contract."""


class LabelError(TallyfoldError):
    """A label dimension is inconsistent or lacks a token."""


class ConfigError(TallyfoldError):
    """A configuration can't be used."""
