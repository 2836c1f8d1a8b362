"""Parsers by file extension."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.text import extension
from . import golang, lines

Parser = Callable[[DataFrame], tuple]

_PARSERS: dict[str, Parser] = {}


def register(parser: Parser, *extensions: str) -> None:
    """Gives the files of these extensions (in any case, with or without a dot) to a parser; the last registration counts.

    A parser takes files (file_path, content) and returns symbols and imports, and may return the paths it could read.
    """
    for e in extensions:
        _PARSERS[e.lower().lstrip(".")] = parser


register(golang.golang, "go")
register(lines.typescript, "ts", "tsx", "js", "jsx", "mjs", "cjs")
register(lines.python, "py")
register(lines.java, "java")
register(lines.php, "php")
register(lines.rust, "rs")


def extensions() -> list[str]:
    """The extensions that have a parser."""
    return sorted(_PARSERS)


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, imports, parsed) of files (file_path, content); files of other extensions are left out."""
    groups: dict[Parser, list[str]] = {}
    for e, p in _PARSERS.items():
        groups.setdefault(p, []).append(e)
    results = []
    for parser, extensions in groups.items():
        mine = files.where(extension(files["file_path"]).isin(extensions))
        symbols, imports, *read = parser(mine)
        readable = read[0] if read else mine.where("content is not null").select("file_path").distinct()
        results.append((symbols, imports, readable))
    return tuple(reduce(DataFrame.unionByName, part) for part in zip(*results))
