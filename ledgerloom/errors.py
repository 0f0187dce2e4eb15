"""Errors of queries and commits, by what a caller can do about them."""


class LedgerError(Exception):
    """Base of all."""


class InvalidRequest(LedgerError, ValueError):
    """The request itself is wrong; no job has run."""


class FailedPrecondition(LedgerError):
    """The request is well formed but does not fit the store's state (a pin, an expired cursor)."""


class NotFound(LedgerError):
    """An artifact that the snapshot should hold is not there."""


class DataLoss(LedgerError):
    """A stored value cannot be read as what it should be."""


class CommitRejected(LedgerError):
    """A commit breaks a rule; nothing was written. ``rule`` names it."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule
