"""Generated, minified, vendored or data files among source code."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import BROADCAST_ROWS, Scratch

#: Phrases of generation notices (lower case), fixed values. A 'notice' tells that a tool wrote the file where its sentence
#: begins with it or a warning stands beside it, an 'origin' only together with a 'warning'; a 'denial' cancels what its own sentence says.
PHRASES = {
    "notice": [
        "code generated by", "code generated via", "code generated from", "@generated", "<auto-generated", "<autogenerated", "autogenerated file", "auto-generated file", "automatically generated", "automatically produced", "automatically created by", "auto-generated by", "autogenerated by", "auto-generated from", "autogenerated from", "this file is generated", "this file was generated", "this file has been generated", "this is a generated file", "generated file, do not", "generated code -- do not", "generated code. do not", "machine generated", "machine-generated", "do not edit: generated", "do not edit - generated", "changes are lost when", "changes will be overwritten", "changes will be lost", "edits are overwritten", "edits will be overwritten", "edits will be lost", "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "généré automatiquement", "généré par", "ne pas modifier ce fichier", "generado automáticamente", "generado por", "generato automaticamente", "gerado automaticamente", "自动生成", "自動生成", "автоматически сгенерирован", "сгенерировано автоматически",
    ],
    "origin": ["generated by", "generated from", "generated via", "generated with", "generated using", "produced by", "produced from", "compiled from", "created by the", "output of", "emitted by", "erzeugt von", "erzeugt aus"],
    "warning": ["do not edit", "do not modify", "do not change", "don't edit", "not edit by hand", "do not hand-edit", "do not touch", "nicht von hand", "nicht bearbeiten", "ne pas modifier", "ne pas éditer", "no editar", "no modificar", "non modificare", "请勿", "編集しない", "не редактировать", "overwritten", "regenerate"],
    "denial": ["not generated", "used to be generated", "no longer generated", "was once generated", "formerly generated", "previously generated", "originally generated", "once generated", "not auto-generated", "not autogenerated", "not automatically generated", "not a generated", "no generated", "hand-written", "handwritten", "written by hand", "maintained by hand", "by hand now", "edit freely", "nicht generiert", "nicht erzeugt", "nicht automatisch"],
}
#: What may stand before a notice at its sentence's beginning: a call for attention, and the file as its subject. Fixed pattern.
_LEAD = re.compile(
    r"[\W_]*(?:(?:warning|note|notice|attention|caution|important|achtung|hinweis|attention|aviso|внимание|注意)[\W_]+)?(?:(?:this|the|these|diese[rs]?|dies|der|die|das|ce|cette|ceci|le|la|este|esta|esto|el|questo|este|этот)\s+)?"
    r"(?:(?:source|go|java|client|api)\s+)?(?:(?:file|files|code|source|module|class|document|content|contents|datei|quelltext|quelldatei|fichier|code|archivo|fichero|código|file|arquivo|файл|код)\s*)?"
    r"(?:(?:is|was|were|are|has been|have been|wurde|ist|wird|est|a été|fue|ha sido|è|è stato|foi|был|была)\s+)?[\W_]*|[\W_]*(?:本|此|该|この)?(?:文件|代码|ファイル|コード)?(?:由|は|是)?[^\s。]*"
)
#: Where a sentence of a comment ends: after its mark, or at a line without words.
_SENTENCE = re.compile(r"[.!?;。！？]+(?=[\s*/#\"']|\Z)|[。！？]|\n[^\w\n]*(?=\n|\Z)")
#: Directories of third-party code, fixed values.
VENDOR_DIRS = ["vendor", "_vendor", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "godeps", "extern", "external", "externals", "deps", "site-packages", "pods", "carthage"]
#: Files that package managers write, fixed values.
LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock", "cargo.lock", "go.sum", "poetry.lock", "pipfile.lock", "gemfile.lock", "pdm.lock", "uv.lock", "flake.lock", "mix.lock", "pubspec.lock", "packages.lock.json", "gradle.lockfile"]
#: Suffixes of minified files, fixed values; they only lower the length that counts as minified.
MINIFIED_SUFFIX = re.compile(r"[.-](?:min|bundle|packed)\.(?:js|mjs|cjs|ts|css)$|\.[0-9a-f]{8,}\.(?:js|mjs|cjs|ts)$|\.chunk\.(?:js|mjs|cjs)$", re.I)

#: Names that generators give, fixed patterns. Such a file is generated unless it shows handwork: imports of the project with prose comments.
GENERATED_NAME = re.compile(r"\.(?:pb|pb\.gw|gen|generated|g|designer)\.\w+$|_(?:pb2|pb2_grpc|gen|generated)\.\w+$|[a-z0-9]Generated\.\w+$|/zz_generated[._]|/(?:generated|__generated__)/", re.I)
_HAND = re.compile(r"^[ \t]*(?://+|/\*\*?|\*|#(?!\[)|\"\"\"|''')[ \t]*[^\W\d_]\w*(?:[ \t]+\S+){2,}", re.M)

#: Code characters per line, without comments and literals, from which a file is minified; with a minified suffix, the second.
MINIFIED_LINE, MINIFIED_NAMED_LINE = 160, 110
#: Share of a file's characters, without comments and white space, in literals, from which it is data.
DATA_SHARE = 0.65
#: Share of a file's distinct lines that one known library has, from which it is a copy.
COPY_SHARE = 0.6
#: Lines that more libraries than this have tell none of them and do not count; files that this leaves undecided are held against whole vendored files.
COMMON_LIBRARIES = 20
#: Characters from which a line counts for that.
LINE_CHARS = 12
#: Pieces in which lines are looked up, since one may stand in a third of all files.
SALTS = 8

#: Banners of published libraries in a file's header: name, version and holder. Fixed patterns.
_BANNER = re.compile(
    r"this file is part of (?:the )?[\w.@/-]+,? v?\d+\.\d+|[\w@/-]+\s+v?\d+\.\d+(?:\.\d+)?[^\n]*(?:\|\s*[^\n|]*licen[cs]e|\|\s*(?:bsd|mit|apache|isc|mpl|lgpl|gpl)[^\n]*\||built \d{4} by)"
    r"|\(c\)\s*\d{4}[^\n]*\bcontributors\b|copyright \(c\)\s*\d{4}[^\n]*\bdevelopers\b[^\n]*\b(?:apache|mit|bsd|isc|mpl)",
    re.I,
)
_LEXER = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#(?!\[)[^\n]*|^[ \t]*(?:\"\"\".*?\"\"\"|'''.*?'''))|(?P<literal>\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<![\w.])(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\b)",
    re.S | re.M,
)
_CODE_LINE = re.compile(r"^(?!\s*(?://|/\*|\*|#(?!\[)|<!--|--|;|\"\"\"|'''|<\?php|<\?\s*$|declare\(strict|['\"]use strict|package [\w.]+;?\s*$|$)).+$", re.M)


def _header(text: str) -> str:
    """The lines before the first line of code; block comments count whole."""
    at = 0
    while m := _CODE_LINE.search(text, at):
        begin = text.rfind("/*", 0, m.start())
        if begin >= 0 and text.find("*/", begin) >= m.start():  # inside a block comment
            end = text.find("*/", m.start())
            at = len(text) if end < 0 else end + 2
            continue
        return text[: m.start()]
    return text


def _tail(text: str) -> str:
    """The comment lines at the end: some tools sign there."""
    lines = text.rstrip().split("\n")
    at = len(lines)
    while at and re.match(r"\s*(?://|#(?!\[)|\*|/\*|<!--|--)", lines[at - 1]):
        at -= 1
    return "\n".join(lines[at:])


def _told(text: str, phrases) -> set[str]:
    """'notice', 'origin' and 'warning' as far as a comment states them and its sentence does not deny them, and 'denial'."""
    text = text.lower()
    found = list(phrases.iter(text))
    if not found:
        return set()
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    per: dict[int, list] = {}
    for begin, word, kind in found:
        per.setdefault(bisect_right(ends, begin), []).append((begin, kind))
    told = set()
    for k, hits in per.items():
        kinds = {kind for _, kind in hits}
        if "denial" in kinds:
            told.add("denial")
            continue
        told |= kinds - {"notice"}
        start = ends[k - 1] if k else 0
        if any(kind == "notice" for _, kind in hits):
            first = min(begin for begin, kind in hits if kind == "notice")
            line = max(start, text.rfind("\n", 0, first) + 1)
            told |= {"notice"} if _LEAD.fullmatch(text, start, first) or _LEAD.fullmatch(text, line, first) else {"origin"}
    return told


def _kind(path: str, text: str, phrases) -> str | None:
    head = _header(text)
    told = _told(head, phrases)
    if "notice" not in told:
        told |= _told(_tail(text), phrases)
    if "notice" in told or {"origin", "warning"} <= told:
        return "generated"
    if _BANNER.search(head):
        return "vendored"
    literal, kept, at = 0, [], 0
    for m in _LEXER.finditer(text):
        kept.append(text[at : m.start()])
        at = m.end()
        if m.lastgroup == "literal":
            literal += m.end() - m.start()
    kept.append(text[at:])
    code = "".join(kept)
    solid = len("".join(code.split()))
    if literal > DATA_SHARE * (solid + literal):
        return "data"
    if GENERATED_NAME.search(path) and "denial" not in told and not _HAND.search(text):
        return "generated"
    lines = sum(1 for x in code.split("\n") if x.strip())
    if lines and solid / lines >= (MINIFIED_NAMED_LINE if MINIFIED_SUFFIX.search(path) else MINIFIED_LINE):
        return "minified"
    return None


_JUDGED = pa.schema([("rel_path", pa.string()), ("kind", pa.string()), ("lines", pa.list_(pa.int64()))])


def _line_hashes(text: str) -> np.ndarray:
    """Hashes of the distinct lines that count, without the space around them."""
    lines = {x for x in map(str.strip, text.split("\n")) if len(x) > LINE_CHARS}
    return np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (rel_path, by_path, content) as (rel_path, kind, lines): lines only of what is open or vendored."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for kind, each in PHRASES.items():
        for w in each:
            words.add_word(w, (w, kind))
    words.make_automaton()
    phrases = _Phrases(words)
    for b in batches:
        kinds, lines = [], []
        for path, kind, text in zip(*(b.column(c).to_pylist() for c in ("rel_path", "by_path", "content"))):
            text = (text or "").replace("\r\n", "\n")
            kind = kind or (_kind(path, text, phrases) if text else None)
            kinds.append(kind)
            lines.append(_line_hashes(text) if kind in (None, "vendored") else [])
        yield pa.RecordBatch.from_arrays([b.column("rel_path"), pa.array(kinds, pa.string()), pa.array(lines, _JUDGED.field("lines").type)], schema=_JUDGED)


class _Phrases:
    """Matches of the automaton that begin at a word's start."""

    def __init__(self, automaton):
        self.automaton = automaton

    def iter(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(begin, phrase, kind) of each match."""
        for end, (word, kind) in self.automaton.iter(text):
            begin = end + 1 - len(word)
            before = text[begin - 1] if begin else " "
            if not (before.isascii() and before.isalpha() and word[0].isascii() and word[0].isalpha()):
                yield begin, word, kind


def _path_kind(path: Column) -> Column:
    """What the path alone tells: third-party directories (below the repository) and lockfiles."""
    dirs = F.slice(F.split(F.lower(path), "/"), 2, F.greatest(F.size(F.split(path, "/")) - 2, F.lit(0)))
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(F.arrays_overlap(dirs, F.lit(VENDOR_DIRS)), "vendored").when(name.isin(LOCKFILES), "generated")


def _library(path: Column) -> Column:
    """The library of a vendored file, whatever the repository: what stands below the third-party directory, else the file's name."""
    below = F.regexp_extract(F.lower(path), rf"/(?:{'|'.join(VENDOR_DIRS)})/([\w-]+\.(?:com|org|net|in|dev)/[^/]+/[^/]+(?=/)|@[^/]+/[^/]+|[^/]+)", 1)
    return F.regexp_replace(F.when(below != "", below).otherwise(F.lower(F.substring_index(path, "/", -1))), r"(?:[.-]min)?\.\w{1,4}$", "")


def _whole_copies(s: Scratch, judged: DataFrame, rows: DataFrame) -> DataFrame:
    """(row) of those rows that share COPY_SHARE of the larger one's lines with some vendored file, whatever lines these are.

    Equal sets of lines are compared once. If two sets share that many lines, they share one of the rarest of each, as
    many as may be missing and one more; so only pairs that share one of these are compared, and no pair is lost.
    """

    def sets(files: DataFrame) -> DataFrame:
        each = files.where("size(lines) > 0").select(F.sort_array("lines").alias("lines")).distinct()
        return s.cut(each.withColumn("id", F.monotonically_increasing_id()))

    open_ = judged.join(rows, "row", "left_semi")
    mine, theirs = sets(open_), sets(judged.where("kind = 'vendored'"))
    often = s.cut(theirs.select(F.explode("lines").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")))

    def rarest(t: DataFrame, *names: str) -> DataFrame:
        known = t.select("id", F.size("lines").alias("size"), F.explode("lines").alias("x")).join(often, "x")
        at = F.row_number().over(Window.partitionBy("id").orderBy("n", "x")).alias("at")
        placed = known.select("id", "size", "x", at, F.count(F.lit(1)).over(Window.partitionBy("id")).alias("known"))
        return placed.where(f"at <= known - {COPY_SHARE} * size + 1").select("x", F.col("id").alias(names[0]), F.col("size").alias(names[1]))

    near = rarest(mine, "id", "size").join(rarest(theirs, "id2", "size2"), "x").where(f"least(size, size2) >= {COPY_SHARE} * greatest(size, size2)")
    pairs = near.select("id", "id2").distinct().join(mine, "id").join(theirs.select(F.col("id").alias("id2"), F.col("lines").alias("lines2")), "id2")
    alike = pairs.where(f"size(array_intersect(lines, lines2)) >= {COPY_SHARE} * greatest(size(lines), size(lines2))").select("lines").distinct()
    return open_.select("row", F.sort_array("lines").alias("lines")).join(alike, "lines", "left_semi").select("row")


def not_hand_written(files: DataFrame) -> DataFrame:
    """(rel_path, kind) of files that are generated, vendored, minified or data; one row per path.

    The path's rules come first, then notices and banners in the header, the share of literals
    and the code per line. Of the rest, a file most of whose lines also stand in one library
    among the files found to be vendored is a copy ('vendored' too), and so is one that lines of very many
    libraries leave undecided, if it and some vendored file have most of their lines in common. A null or empty content is judged by its path, a null path left out.
    Contents are read once and never shuffled.
    """
    s = Scratch(files.sparkSession, "filter")
    there = files.where("rel_path is not null").select("rel_path", _path_kind(F.col("rel_path")).alias("by_path"), "content")
    judged = s.cut(there.mapInArrow(_judge, "rel_path string, kind string, lines array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    known = judged.groupBy("rel_path").agg(F.max("kind").alias("kind"))  # rescanned files are judged alike

    library = judged.where("kind = 'vendored'").select(_library(F.col("rel_path")).alias("library"), F.explode("lines").alias("x")).distinct()
    often = library.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("library").alias("library"))
    common = often.where(f"n > {COMMON_LIBRARIES}").select("x", F.lit(None).cast("string").alias("library"), F.lit(1).alias("one"))
    several = library.join(often.where(f"n between 2 and {COMMON_LIBRARIES}").select("x", F.col("library").alias("first")), "x")
    several = several.select("x", "library", (F.col("library") == F.col("first")).cast("int").alias("one"))  # one of a line's rows counts it
    told, n = s.cut_counting(often.where("n = 1").select("x", "library", F.lit(1).alias("one")).unionByName(several).unionByName(common))

    # of each open row the lines that one library has, and those that tell none (library null)
    open_ = judged.where("kind is null").select("row", F.size("lines").alias("lines"), F.explode("lines").alias("x"))
    if n["rows"] <= BROADCAST_ROWS:
        met = open_.join(F.broadcast(told), "x")
    else:  # a line of very many files is looked up in pieces
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = open_.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["x", "salt"])
    per = met.groupBy("row", "lines", "library").agg(F.count(F.lit(1)).alias("same"), F.sum("one").alias("known"))
    best = F.max(F.when(F.col("library").isNotNull(), F.col("same")))
    shared = F.coalesce(F.sum(F.when(F.col("library").isNull(), F.col("same"))), F.lit(0))
    each = per.groupBy("row", "lines").agg(best.alias("same"), shared.alias("shared"), F.sum("known").alias("known"))
    copy = F.coalesce(F.expr(f"same >= {COPY_SHARE} * (lines - shared)"), F.lit(False))
    told_of = each.select("row", copy.alias("copy")).where(f"copy or shared > 0 and known >= {COPY_SHARE} * lines")
    told_of, n = s.cut_counting(told_of, undecided=F.count_if(~F.col("copy")))
    copies = told_of.where("copy").select("row")
    if n["undecided"]:
        copies = copies.unionByName(_whole_copies(s, judged, told_of.where("not copy").select("row")))
    copies = judged.select("row", "rel_path").join(copies, "row", "left_semi").select("rel_path", F.lit("vendored").alias("copied")).distinct()
    return known.join(copies, "rel_path", "left").select("rel_path", F.coalesce("kind", "copied").alias("kind")).where("kind is not null")
