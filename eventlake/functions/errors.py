"""Status codes of errors, as a service would answer with them."""

from __future__ import annotations

from ..sources.log import ConsistencyConditionViolated, ContextExists, ContextNotFound, InvalidContextName


class Corrupted(Exception):
    pass


class SnapshotNotFound(KeyError):
    pass


#: Status codes by kind of error; the first that fits.
STATUS = ((ConsistencyConditionViolated, "ABORTED"), (Corrupted, "INTERNAL"), (ContextNotFound, "NOT_FOUND"), (SnapshotNotFound, "NOT_FOUND"), (ContextExists, "ALREADY_EXISTS"), (InvalidContextName, "INVALID_ARGUMENT"), (OSError, "INTERNAL"))


def status(error: Exception) -> tuple[str, str]:
    """Code and message; errors of no known kind are UNKNOWN."""
    code = next((c for kind, c in STATUS if isinstance(error, kind)), "UNKNOWN")
    return code, str(error)
