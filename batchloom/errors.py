"""The two outcomes that are not results."""

from __future__ import annotations


class Refusal(Exception):
    """The request was understood but the data cannot support an answer.

    A refusal carries its reason and must never be turned into a number.
    """

    def __init__(self, reason: str, detail: dict | None = None):
        super().__init__(reason)
        self.reason = reason
        self.detail = detail or {}


class DataError(ValueError):
    """The input is malformed and has to be corrected by whoever supplied it."""
