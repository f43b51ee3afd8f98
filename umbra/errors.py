"""Errors that never repeat a value of the data: a code, and a reference that is a hash."""

from __future__ import annotations

import hashlib


def reference(value: str) -> str:
    return "ref:" + hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:12]


class Refused(ValueError):
    """An input or output that can't be released; `code` says why."""

    def __init__(self, code: str, where: str = ""):
        super().__init__(f"{code} {where}".strip())
        self.code = code
