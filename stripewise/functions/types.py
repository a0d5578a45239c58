"""ORC types: the tree with its pre-order ids, their names, and what they are in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import OrcFormatError

# Fixed values of the format: kinds of types by number, and how they are shown.
KINDS = ["boolean", "byte", "short", "int", "long", "float", "double", "string", "binary", "timestamp", "list", "map", "struct", "union", "decimal", "date", "varchar", "char", "timestamp_instant"]
SHOWN = {"int": "INTEGER", "timestamp_instant": "TIMESTAMP INSTANT"}
PLAIN = {"boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "varchar": T.StringType(), "char": T.StringType(), "binary": T.BinaryType(), "date": T.DateType()}


@dataclass
class OrcType:
    """A type and its children; ``id`` counts from the root (0) in pre-order."""

    id: int
    kind: str
    names: list[str] = field(default_factory=list)
    children: list[OrcType] = field(default_factory=list)
    length: int | None = None
    precision: int | None = None
    scale: int | None = None

    def ids(self) -> list[int]:
        """Own id and those of everything below."""
        return [self.id, *(i for c in self.children for i in c.ids())]

    def contains(self, id_: int) -> bool:
        return id_ in self.ids()

    def child(self, name: str) -> OrcType | None:
        """A child by its exact name."""
        return next((c for n, c in zip(self.names, self.children, strict=False) if n == name), None)

    def shown(self) -> str:
        if self.kind in ("varchar", "char"):
            return f"{self.kind.upper()}({self.length})"
        if self.kind == "decimal":
            return f"DECIMAL({self.precision}, {self.scale})"
        return SHOWN.get(self.kind, self.kind.upper())

    def lines(self, name: str = "ROOT", depth: int = 0) -> list[str]:
        """The tree as lines: a struct's or other parent's children are indented below it."""
        head = "  " * depth + (name if not depth and self.kind == "struct" else f"{name} {self.shown()}")
        names = self.names or {"list": ["element"], "map": ["key", "value"]}.get(self.kind, [f"_union_{k}" for k in range(len(self.children))])
        return [head, *(x for n, c in zip(names, self.children, strict=True) for x in c.lines(n, depth + 1))]

    def needs_custom_reader(self) -> bool:
        """Whether Spark's own reader refuses a file that has this."""
        return self.kind in ("union", "timestamp_instant") or any(c.needs_custom_reader() for c in self.children)


def tree(types: list[dict]) -> OrcType:
    """The type tree from the footer's list; the root must be a struct."""
    if not types or KINDS[types[0]["kind"] or 0] != "struct":
        raise OrcFormatError("UnexpectedType", "the root is not a struct")

    def build(k: int) -> OrcType:
        t = types[k]
        return OrcType(k, KINDS[t["kind"] or 0], t["field_names"], [build(c) for c in t["subtypes"]], t["length"], t["precision"], t["scale"])

    return build(0)


def to_spark(t: OrcType, timestamps: str = "micros") -> T.DataType:
    """The Spark type of a column. timestamps: ``micros`` (timestamp types), ``nanos`` (bigint since 1970) or ``decimal`` (decimal(38,9) seconds).
    A union becomes a struct of its tag and a field for each variant."""
    if t.kind in PLAIN:
        return PLAIN[t.kind]
    if t.kind == "decimal":
        return T.DecimalType(t.precision or 38, t.scale or 0)
    if t.kind in ("timestamp", "timestamp_instant"):
        return {"nanos": T.LongType(), "decimal": T.DecimalType(38, 9)}.get(timestamps) or (T.TimestampNTZType() if t.kind == "timestamp" else T.TimestampType())
    below = [to_spark(c, timestamps) for c in t.children]
    if t.kind == "list":
        return T.ArrayType(below[0])
    if t.kind == "map":
        return T.MapType(below[0], below[1])
    if t.kind == "union":
        return T.StructType([T.StructField("tag", T.ByteType()), *(T.StructField(f"_union_{k}", b) for k, b in enumerate(below))])
    return T.StructType([T.StructField(n, b) for n, b in zip(t.names, below, strict=True)])
