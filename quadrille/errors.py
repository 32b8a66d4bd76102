"""Errors and warnings; every message starts with its code."""

from __future__ import annotations


class PanelError(Exception):
    """An error whose message begins with a code such as E-FUNC-ARITY."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code} {message}")
        self.code = code


class PanelWarning(UserWarning):
    """A warning whose message begins with a code such as W-PIT-PARTIAL."""
