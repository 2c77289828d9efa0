"""Exceptions with the codes that the request surface reports."""

import hmac


class EngineError(Exception):
    status, code = 500, "internal"


class BadRequest(EngineError):
    status, code = 400, "bad_request"


class Unauthorized(EngineError):
    status, code = 401, "unauthorized"


class NotFound(EngineError):
    status, code = 404, "not_found"


class PathNotIndexed(NotFound):
    pass


class DimMismatch(BadRequest):
    pass


class TooManyMediaTypes(BadRequest):
    pass


class TextNotAMediaFilter(BadRequest):
    pass


class FingerprintMismatch(EngineError):
    pass


class SchemaMismatch(EngineError):
    pass


class MediaError(EngineError):
    pass


class EmbedError(EngineError):
    pass


class AccessDenied(EngineError):
    """A service turned the token down."""


class ServerFailure(EngineError):
    """A service answered with an error."""


class NetworkFailure(EngineError):
    """A service could not be reached, or gave no sense."""


def authorised(header: str | None, expected: str) -> None:
    """Holds a bearer header against the expected token, in constant time."""
    scheme, _, token = (header or "").partition(" ")
    if scheme.lower() != "bearer" or not hmac.compare_digest(token.strip().encode(), expected.encode()):
        raise Unauthorized("missing or invalid bearer")


def envelope(error: Exception) -> tuple[int, dict]:
    """Status and body; what went wrong inside is not told."""
    if isinstance(error, EngineError) and error.status != 500:
        return error.status, {"error": {"code": error.code, "message": str(error)}}
    return 500, {"error": {"code": "internal", "message": "internal error"}}
