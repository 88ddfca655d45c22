"""Structured findings: what went wrong or is worth knowing, with a stable code.

Every code is a plain string that callers can match. Errors that end a compilation are raised as
`EngineError`, which carries its findings; per-value findings travel as data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    severity: str = "error"
    details: dict[str, Any] = field(default_factory=dict, compare=False)
    span: tuple[int, int] | None = None
    step_id: str | None = None


class EngineError(Exception):
    """One or more errors that keep an expression, step or model from being compiled."""

    def __init__(self, *diagnostics: Diagnostic):
        self.diagnostics = list(diagnostics)
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics))

    @property
    def code(self) -> str:
        return self.diagnostics[0].code


def fail(code: str, message: str, span: tuple[int, int] | None = None, **details: Any):
    raise EngineError(Diagnostic(code, message, span=span, details=details))
