"""Exceptions raised on the driver."""

from __future__ import annotations


class TallyError(Exception):
    """Base class of the package's own errors."""


class FilterError(TallyError):
    """A filter request breaks the contract. ``code`` is stable, the message is for people."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class IngestError(TallyError):
    """A source cannot be ingested; nothing was published."""


class NotReadyError(TallyError):
    """No complete, coherent generation can be served."""


class StatisticsError(TallyError):
    """Finite inputs gave a statistic that is not a finite number."""
