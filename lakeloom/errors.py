"""Errors with stable codes."""

from __future__ import annotations

CODES = (
    "COLUMN_NOT_FOUND", "TABLE_NOT_FOUND", "INVALID_FILTER", "INVALID_AGGREGATE", "SCHEMA_MISMATCH",
    "INVALID_FORMAT", "FETCH_FAILED", "QUERY_TIMEOUT", "MEMORY_EXCEEDED", "QUERY_FAILED",
)


class QueryError(Exception):
    """``code`` is one of ``CODES``."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def translated(error: Exception) -> QueryError:
    """The engine's own error as one with a code."""
    if isinstance(error, QueryError):
        return error
    name = (getattr(error, "getCondition", lambda: None)() or "").split(".")[0]
    code = {
        "UNRESOLVED_COLUMN": "COLUMN_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND": "TABLE_NOT_FOUND", "PATH_NOT_FOUND": "TABLE_NOT_FOUND",
        "PARSE_SYNTAX_ERROR": "INVALID_FILTER", "DATATYPE_MISMATCH": "SCHEMA_MISMATCH", "NUM_COLUMNS_MISMATCH": "SCHEMA_MISMATCH",
        "UNABLE_TO_INFER_SCHEMA": "INVALID_FORMAT", "INCOMPATIBLE_COLUMN_TYPE": "SCHEMA_MISMATCH",
    }.get(name, "QUERY_FAILED")
    return QueryError(code, str(error).split("\n")[0])
