"""Errors raised while planning or applying a spec."""

from __future__ import annotations


class SpecError(ValueError):
    """A spec, entry or rule body is not well formed."""


class DatasetError(RuntimeError):
    """The dataset does not offer what the spec reads."""


class NullInputError(ValueError):
    """Rows with missing or undefined input under an `error` policy."""


class UnmappedInputError(ValueError):
    """Rows with undeclared input values under an `error` policy; `values` is a table of all of them (value, n_rows)."""

    def __init__(self, message: str, values=None):
        super().__init__(message)
        self.values = values
