"""Choice of top-level columns by name or by ORC id. The order is the file's, whatever was asked for."""

from __future__ import annotations

from collections.abc import Iterable

from ..errors import ColumnNotFound
from ..functions.types import OrcType


class Projection:
    """Columns that are read; a root column takes all below it."""

    def __init__(self, ids: set[int] | None):
        self.ids = ids  # None: all

    @classmethod
    def all(cls) -> Projection:
        return cls(None)

    @classmethod
    def by_id(cls, root: OrcType, ids: Iterable[int], missing: str = "ignore") -> Projection:
        """By pre-order ids of top-level columns. Ids that are none are ignored, or raise with missing="error"."""
        wanted = list(ids)
        known = {c.id for c in root.children}
        if missing == "error" and (gone := [i for i in wanted if i not in known]):
            raise ColumnNotFound(str(gone[0]), [str(i) for i in sorted(known)])
        return cls({i for i in wanted if i in known})

    @classmethod
    def by_name(cls, root: OrcType, names: Iterable[str], missing: str = "error") -> Projection:
        """By exact names. Unknown names raise, or are ignored with missing="ignore"."""
        out = set()
        for n in names:
            c = root.child(n)
            if c is not None:
                out.add(c.id)
            elif missing == "error":
                raise ColumnNotFound(n, root.names)
        return cls(out)

    def includes(self, root: OrcType, id_: int) -> bool:
        """Whether the column with an id, or the root column above it, is read."""
        return any(c.contains(id_) and (self.ids is None or c.id in self.ids) for c in root.children)

    def names(self, root: OrcType) -> list[str]:
        return [n for n, c in zip(root.names, root.children, strict=True) if self.ids is None or c.id in self.ids]
