"""Command line: info, export, stats, layout, index and bloom of ORC files. ``-`` is standard input."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable

from .errors import ColumnNotFound, OrcFormatError
from .operators import export
from .sources.bytesource import MemorySource
from .sources.metadata import OrcFile, described

# How kinds of statistics are called, and codecs written.
CALLED = {"integer": "Integer", "double": "Double", "string": "String", "bucket": "Bucket", "decimal": "Decimal", "date": "Date", "binary": "Binary", "timestamp": "Timestamp", "collection": "Collection"}
CODEC_NAMES = {"none": "None", "zlib": "Zlib", "snappy": "Snappy", "lzo": "Lzo", "lz4": "Lz4", "zstd": "Zstd"}


def opened(path: str) -> OrcFile:
    return OrcFile(MemorySource(sys.stdin.buffer.read(), "-")) if path == "-" else OrcFile(path)


def info(file: OrcFile, verbose: bool = False) -> list[str]:
    out = [f"File: {file.source.name}", f"Format version: {file.version}", f"Compression: {CODEC_NAMES.get(file.codec, file.codec)}", f"Row index stride: {file.stride or 'None'}", f"Rows: {file.rows}", f"Stripes: {len(file.stripes)}", "", "Schema:", *file.schema.lines()]
    if verbose:
        out += ["", "Stripe layout:"]
        for s in file.stripes:
            out += [f"Stripe {s.number}:", f"  offset: {s.offset}", f"  index length: {s.index_length}", f"  data length: {s.data_length}", f"  footer length: {s.footer_length}", f"  rows: {s.rows}", f"  writer timezone: {s.timezone or 'None'}"]
    return out


def _number(x) -> str:
    return format(x, "g") if isinstance(x, float) and x == int(x) and abs(x) < 1e15 else str(x)


def _moment(ms: int) -> str:
    text = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).isoformat(" ", "milliseconds")
    return text.removesuffix(".000")


def _typed(stats: dict) -> list[tuple[str, str]]:
    """Name and value of what statistics of a type have."""
    kind = next((k for k in CALLED if stats[k] is not None), None)
    if kind is None:
        return []
    s, out = stats[kind], [("Data type", CALLED[kind])]
    both = lambda show=str: [(n, show(s[k])) for n, k in (("Minimum", "min"), ("Maximum", "max")) if s[k] is not None]
    total = [("Sum", _number(s["sum"]))] if s.get("sum") is not None else []
    if kind in ("integer", "double"):
        return out + both(_number) + total
    if kind == "string":
        low, high = s["min"] if s["min"] is not None else s["lower"], s["max"] if s["max"] is not None else s["upper"]
        return [*out, ("Minimum", str(low)), ("Maximum", str(high)), *total, ("IsExactMin", str(s["min"] is not None).lower()), ("IsExactMax", str(s["max"] is not None).lower())]
    if kind == "bucket":
        return [*out, ("True count", str(s["counts"][0] if s["counts"] else "unknown"))]
    if kind == "timestamp":
        return [*out, *both(_moment), *[(n, _moment(s[k])) for n, k in (("Minimum UTC", "min_utc"), ("Maximum UTC", "max_utc")) if s[k] is not None]]
    if kind == "date":
        return out + both(lambda d: str(dt.date(1970, 1, 1) + dt.timedelta(days=d)) if -719162 <= d <= 2932896 else str(d))
    return out + both() + total if kind != "binary" else out + total


def _statistics(columns: list[dict]) -> list[str]:
    out = []
    for k, s in enumerate(columns):
        out += [f"## Column {k}", *[f"* Data type {v}" if n == "Data type" else f"* {n}: {v}" for n, v in _typed(s)]]
        out += [f"* Num values: {s['n_values'] if s['n_values'] is not None else 'unknown'}", f"* Has nulls: {str(s['has_null'] is not False).lower() if s['has_null'] is not None else 'unknown'}", ""]
    return out


def stats(file: OrcFile) -> list[str]:
    out = ["# Column stats", f'File "{file.source.name}" has {len(file.statistics)} columns', "", *_statistics(file.statistics), "# Stripe stats", f'File "{file.source.name}" has {len(file.stripes)} stripes', ""]
    for s in file.stripes:
        out += [f"----- Stripe {s.number} -----", "", *_statistics(s.statistics)]
    return out


def layout(file: OrcFile) -> list[str]:
    whole = {
        "file": file.source.name, "format_version": file.version, "compression": None if file.codec == "none" else file.codec, "rows": file.rows,
        "stripes": [{"index": s.number, "offset": s.offset, "index_length": s.index_length, "data_length": s.data_length, "footer_length": s.footer_length, "rows": s.rows, "streams": s.streams(), "encodings": [e | {"dictionary_size": e["dictionary_size"] or 0} for e in s.encodings()]} for s in file.stripes],
    }
    return json.dumps(whole, indent=2).split("\n")


def index(file: OrcFile, column: str) -> list[str]:
    c = file.column(column)
    out = [f"File: {file.source.name} | Column: {column} (index {c.id})", f"Type: {c.shown()}", f"Stripes: {len(file.stripes)}"]
    for s in file.stripes:
        out.append(f"Stripe {s.number}: rows_per_group={file.stride or 10000} total_rows={s.rows}")
        entries = s.row_index(c.id)
        if entries is None:
            out.append("  no row index")
            continue
        for k, ((a, b), e) in enumerate(zip(s.row_groups, entries, strict=False)):
            d = described(e["statistics"])
            shown = [f"values={d['n_values']}", *(f"{n}={d[n]}" for n in ("min", "max") if d[n] is not None)]
            out.append(f"  Row group {k} rows [{a},{b}) -> {', '.join(shown)}")
    return out


def bloom(file: OrcFile, column: str | None = None, value: str | None = None) -> list[str]:
    """Which columns have Bloom filters, and whether they might contain a value, hashed as the column's type."""
    chosen = [(column, file.column(column))] if column else list(zip(file.schema.names, file.schema.children, strict=True))
    out = [f"File: {file.source.name}", f"Stripes: {len(file.stripes)}", ""]
    found = [(s, n, c, b) for s in file.stripes for n, c in chosen if (b := s.blooms(c.id))]
    if not found:
        return [*out, "No bloom filters found"]
    if value is None:
        first = {c.id: (n, c, b) for s, n, c, b in reversed(found)}
        return [*out, "Columns with Bloom Filters:", *[f"  Column {k} ({n}): {len(b)} row groups, {b[0].n_hashes} hash functions, {b[0].n_bits} bits/filter" for k, (n, c, b) in sorted(first.items())]]
    for s in file.stripes:
        out.append(f"Stripe {s.number}:")
        for _, n, c, b in (x for x in found if x[0] is s):
            out.append(f"  Column {c.id} ({n}):")
            for k, f in enumerate(b):
                try:
                    sure = str(f.might_contain(value, c.kind)).lower()
                except (ValueError, ArithmeticError):
                    sure = "false"  # no value of this type reads so
                out.append(f'    Row group {k}: {len(f.words)} words, {f.n_bits} bits, might_contain("{value}") = {sure}')
    return out


def main(args: list[str] | None = None, write: Callable[[str], None] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stripewise", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("info")
    one.add_argument("files", nargs="+")
    one.add_argument("--verbose", "-v", action="store_true")
    one.add_argument("--row-count-only", "-r", action="store_true")
    two = sub.add_parser("export")
    two.add_argument("file")
    two.add_argument("--format", "-f", choices=export.FORMATS, default="csv")
    two.add_argument("--columns", "-c", type=lambda x: x.split(","))
    two.add_argument("--num-rows", "-n", type=int)
    two.add_argument("--output", "-o")
    two.add_argument("--batch-size", type=int, default=8192)
    for name in ("stats", "layout"):
        sub.add_parser(name).add_argument("file")
    three = sub.add_parser("index")
    three.add_argument("file")
    three.add_argument("column")
    four = sub.add_parser("bloom")
    four.add_argument("file")
    four.add_argument("--column", "-c")
    four.add_argument("--test", "-t")
    a = p.parse_args(args)
    write = write or (lambda line: print(line))
    try:
        if a.command == "info":
            for k, f in enumerate(a.files):
                file = opened(f)
                if a.row_count_only:
                    write(f"{f}: {file.rows}")
                    continue
                for line in ([] if not k else ["", "---", ""]) + info(file, a.verbose):
                    write(line)
        elif a.command == "export":
            if a.output:
                with open(a.output, "w", encoding="utf-8", newline="") as out:
                    out.writelines(x + "\n" for x in export.lines(opened(a.file), a.format, a.columns, a.num_rows, a.batch_size))
            else:
                for line in export.lines(opened(a.file), a.format, a.columns, a.num_rows, a.batch_size):
                    write(line)
        else:
            file = opened(a.file)
            for line in {"stats": lambda: stats(file), "layout": lambda: layout(file), "index": lambda: index(file, a.column), "bloom": lambda: bloom(file, a.column, a.test)}[a.command]():
                write(line)
    except (OrcFormatError, ColumnNotFound, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
