"""Failures, by what went wrong."""


class FieldloomError(Exception):
    """Base of all failures."""


class TransformError(FieldloomError, ValueError):
    """An operator was given arguments or rows that it doesn't accept."""


class ContractError(TransformError):
    """Rows break what a dataset declares: schema, keys, universe or coverage."""


class IdentityNotFound(FieldloomError):
    """No candidate has the name."""


class IdentityAmbiguous(FieldloomError):
    """Several candidates have the name."""


class PlanError(FieldloomError):
    """A recipe graph can't be planned."""


class RequestError(FieldloomError, ValueError):
    """A request names selectors that its endpoint doesn't take, lacks some, or combines them against its rules."""


class TransportError(FieldloomError):
    """A response couldn't be had; status is the HTTP status, or 0."""

    def __init__(self, what: str, status: int = 0, retryable: bool = False):
        super().__init__(what)
        self.status, self.retryable = status, retryable


class NoContent(FieldloomError):
    """A stored response was asked for that isn't there."""


class ResponseCorrupt(FieldloomError):
    """A stored response doesn't hold what its record says."""
