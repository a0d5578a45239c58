"""Errors about ORC files."""


class OrcFormatError(ValueError):
    """A file that is no valid ORC file, or asks for something unsupported. ``kind`` names what is wrong."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class ColumnNotFound(KeyError):
    """A column that the file does not have."""

    def __init__(self, name: str, known: list[str]):
        super().__init__(name)
        self.name, self.known = name, sorted(known)

    def __str__(self) -> str:
        return f"column {self.name!r} not found; the file has: {', '.join(self.known)}"
