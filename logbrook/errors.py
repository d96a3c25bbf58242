"""What can go wrong, by the exit code that a command ends with."""

from __future__ import annotations

# Exit codes of the commands.
EXIT = {"ok": 0, "general": 1, "usage": 2, "source": 3, "schema": 4, "policy": 5, "confirmation": 6, "archive": 7, "integrity": 8, "prepare": 9}


class Failure(Exception):
    """A failure with a code for machines; `kind` names its exit code."""

    kind = "general"

    def __init__(self, message: str, code: str = ""):
        self.code = code or f"E_{self.kind.upper()}"
        super().__init__(f"[{self.code}] {message}")

    @property
    def exit_code(self) -> int:
        return EXIT[self.kind]


def _kind(name: str) -> type[Failure]:
    return type(f"{name.title()}Error", (Failure,), {"kind": name, "__doc__": f"Ends a command with exit code {EXIT[name]}."})


UsageError, SourceError, SchemaError, PolicyError, ConfirmationError, ArchiveError, IntegrityError, PrepareError = (_kind(n) for n in list(EXIT)[2:])
