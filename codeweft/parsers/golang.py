"""Go: imports, functions, methods and types, read from tokens between balanced brackets.

A small helper for Arrow batches; a file whose brackets or literals do not close is dropped whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schemas import SYMBOLS

_TOKEN = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+')|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>\n)|(?P<bad>[\"`'])|(?P<other>[^\s])", re.S)
_PAIR = {")": "(", "]": "[", "}": "{"}
#: Words before a bracket that call nothing, fixed values.
_NO_CALL = set("if for switch select return func go defer range case else map chan struct interface var const type import package".split())
_DIRECTIVE = re.compile(r"//(?:go:|line |export |extern |nolint|[a-z0-9]+:[a-z0-9])")


class _Unbalanced(Exception):
    pass


def _tokens(src: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, partner): partner is the token index of the other bracket, or -1."""
    out, stack = [], []
    for m in _TOKEN.finditer(src):
        kind, text, partner = m.lastgroup, m.group(), -1
        if kind == "bad":
            raise _Unbalanced
        if kind == "open":
            stack.append(len(out))
        elif kind == "close":
            if not stack or out[stack[-1]][1] != _PAIR[text]:
                raise _Unbalanced
            partner = stack.pop()
            k, t, s, _ = out[partner]
            out[partner] = (k, t, s, len(out))
        out.append((kind, text, m.start(), partner))
    if stack:
        raise _Unbalanced
    return out


def _doc(comments: list[str]) -> str:
    """A doc comment's text without its marks, directives and outer blank lines."""
    lines: list[str] = []
    for c in comments:
        if c.startswith("//"):
            if not _DIRECTIVE.match(c):
                lines.append(c[2:].removeprefix(" ").rstrip())
        else:
            lines += [x.rstrip() for x in c[2:-2].split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
    return text + "\n" if text.strip() else ""


def _callee(toks: list, i: int, low: int) -> int:
    """The token at which the expression called by bracket i begins, or -1 if it calls nothing."""
    j = i - 1
    while j > low:
        kind, text, _, partner = toks[j]
        before = toks[j - 1]
        if kind == "close":
            j = partner
            before = toks[j - 1]
            if before[1] == "func":
                return j - 1
            if before[1] == "." and j - 2 > low:  # a type assertion
                j -= 2
            elif j - 1 > low and (before[0] == "close" or before[0] == "word" and before[1] not in _NO_CALL):
                j -= 1
            else:
                return j
        elif kind == "word" and text not in _NO_CALL:
            if before[1] == "." and j - 2 > low:
                j -= 2
                while j > low and toks[j][0] in ("end", "comment"):
                    j -= 1
            elif before[1] == "]":  # the element type of a conversion
                at = before[3]
                return at - 1 if toks[at - 1][1] == "map" else at
            else:
                return j
        else:
            return -1
    return -1


def _calls(src: str, toks: list, a: int, b: int) -> list[str]:
    """The texts of what is called between two tokens, outer before inner."""
    found = []
    for i in range(a + 1, b):
        if toks[i][1] == "(" and toks[i][0] == "open" and (begin := _callee(toks, i, a)) >= 0:
            text = re.sub(r"\s+", " ", src[toks[begin][2] : toks[i][2]]).strip()
            found.append((toks[begin][2], -toks[i][2], text))
    return [t for _, _, t in sorted(found)]


def parse(path: str, src: str) -> tuple[list[tuple], list[str]] | None:
    """(symbol rows, import texts) of a file, or None if it cannot be read."""
    try:
        toks = _tokens(src)
    except _Unbalanced:
        return None
    if next((t[1] for t in toks if t[0] not in ("comment", "end")), "") != "package":
        return None
    line_starts = [0, *(m.end() for m in re.finditer("\n", src))]
    symbols, imports, i, docs = [], [], 0, []

    def place(at: int) -> tuple[int, int]:
        from bisect import bisect_right

        n = bisect_right(line_starts, at)
        return n, len(src[line_starts[n - 1] : at].encode()) + 1

    def until_line_end(k: int) -> int:
        while k < len(toks) and toks[k][0] != "end" and toks[k][1] != ";":
            k = toks[k][3] + 1 if toks[k][0] == "open" else k + 1
        return k

    def add(name, qualified, kind, sig, doc, body, start, end, calls):
        l1, c1 = place(start)
        l2, c2 = place(end)
        symbols.append((path, len(symbols), name, qualified, kind, "go", sig, doc, body, name[:1].isupper(), l1, c1, l2, c2, calls, []))

    def type_spec(k: int, doc: str, nested: list[str]) -> int:
        end = until_line_end(k)
        name, j = toks[k][1], k + 1
        if j < end and toks[j][1] == "[" and toks[j][3] + 1 < end and toks[toks[j][3] + 1][0] == "word" and toks[j + 1][0] == "word" and toks[j][3] - j > 2:
            j = toks[j][3] + 1  # type parameters
        body = src[toks[j][2] : toks[end - 1][2] + len(toks[end - 1][1])] if j < end else ""
        first = toks[j][1] if j < end else ""
        kind = {"struct": "struct", "interface": "interface"}.get(first, "type")
        add(name, name, kind, f"type {name} {body}", doc or _doc(nested), "", toks[k][2], toks[end - 1][2] + len(toks[end - 1][1]), [])
        return end

    blank = 0
    while i < len(toks):
        kind, text, at, partner = toks[i]
        if kind == "end":
            blank += 1
            if blank > 1:
                docs = []
            i += 1
            continue
        if kind == "comment":
            docs.append(text)
            blank = 0
            i += 1
            continue
        blank = 0
        if text == "import":
            end = until_line_end(i)
            imports += [t[1].strip('"') for t in toks[i:end] if t[0] == "string"]
            i = end
        elif text == "func":
            j, recv = i + 1, None
            if toks[j][1] == "(":
                inside = [t for t in toks[j + 1 : toks[j][3]] if t[0] not in ("comment", "end")]
                named = len(inside) > 1 and inside[0][0] == "word" and (inside[1][0] == "word" or inside[1][1] in ("*", "("))
                begin = inside[1 if named else 0][2] if inside else toks[j][2] + 1
                recv, j = src[begin : toks[toks[j][3]][2]].strip(), toks[j][3] + 1
            name = toks[j][1]
            k = j + 1
            while k < len(toks) and not (toks[k][1] == "{" and toks[k - 1][1] not in ("struct", "interface")) and toks[k][0] != "end":
                k = toks[k][3] + 1 if toks[k][0] == "open" else k + 1
            body, calls, end = "", [], toks[k - 1][2] + len(toks[k - 1][1])
            sig_end = end
            if k < len(toks) and toks[k][1] == "{":
                close = toks[k][3]
                body, calls, end = src[toks[k][2] : toks[close][2] + 1], _calls(src, toks, k, close), toks[close][2] + 1
                k = close + 1
            doc = _doc(docs)
            shown = "".join(c + "\n" for c in docs)
            add(name, f"({recv}).{name}" if recv is not None else name, "method" if recv is not None else "function", shown + re.sub(r"[ \t]+", " ", src[at:sig_end].strip()), doc, body, at, end, calls)
            i = k
        elif text == "type":
            doc = _doc(docs)
            if toks[i + 1][1] == "(":
                k, nested = i + 2, []
                while k < toks[i + 1][3]:
                    if toks[k][0] == "word":
                        k = type_spec(k, doc, nested)
                        nested = []
                    else:
                        nested += [toks[k][1]] if toks[k][0] == "comment" else []
                        k += 1
                i = toks[i + 1][3] + 1
            else:
                i = type_spec(i + 1, doc, [])
        else:
            i = until_line_end(i)
        docs = []
    return symbols, imports


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist()):
            got = parse(path, content)
            if got:
                rows.append({"file_path": path, "version": zlib.crc32(content.encode()), "symbols": [dict(zip(_FIELDS, s)) for s in got[0]], "imports": got[1]})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_FIELDS = [f.split(" ")[0] for f in SYMBOLS.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([("file_path", pa.string()), ("version", pa.int64()), ("symbols", pa.list_(pa.struct([(f.split(" ")[0], _TYPES[f.split(" ")[1]]) for f in SYMBOLS.split(", ")]))), ("imports", pa.list_(pa.string()))])
_DDL = "file_path string, version bigint, symbols array<struct<" + ", ".join(f.replace(" ", ": ") for f in SYMBOLS.split(", ")) + ">>, imports array<string>"


def parsed(files: DataFrame) -> DataFrame:
    """(file_path, version, symbols, imports) of the files (file_path, content) that can be read; version tells contents of a path apart."""
    files = files.where("content is not null and file_path is not null").select("file_path", "content")
    return files.mapInArrow(_task, _DDL)


def _once(df: DataFrame, place: str) -> DataFrame:
    """The rows of one content of each path, each once by its place."""
    one = F.min("version").over(Window.partitionBy("file_path"))
    return df.withColumn("one", one).where("version = one").drop("one", "version").dropDuplicates(["file_path", place])


def golang(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, imports, parsed paths)."""
    p = parsed(files)
    symbols = _once(p.selectExpr("version", "inline(symbols)"), "ordinal").select(_FIELDS)
    return symbols, _once(p.selectExpr("file_path", "version", "posexplode(imports) as (pos, imp)"), "pos"), p.select("file_path").distinct()
