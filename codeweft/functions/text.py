"""Column expressions on code text and paths. All stay in the JVM; a null gives null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops, fixed values.
STOP_WORDS = "the a an in on at for to of and or with is are it this that fix how what where does do".split()
#: Names that a scan leaves out at any level, fixed values (names with a leading dot are left out anyway).
IGNORED_NAMES = ["node_modules", "vendor", "dist", "bin", "build", "target", "coverage", "storage"]
#: Extensions of binary files, fixed values.
BINARY_EXTENSIONS = "exe bin dll so dylib o a png jpg jpeg gif zip tar gz pdf lock".split()
#: Largest file that a scan takes, in KB.
MAX_FILE_KB = 1024
#: Language of an extension, fixed values.
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust"}
#: Tag of a code fence by extension, fixed values; others have none.
FENCES = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust"}
#: What the path of a test file ends with, or contains. Fixed values.
TEST_ENDINGS = ["_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js"]
TEST_PARTS = ["/test/", "/tests/", "\\test\\", "\\tests\\"]
#: Callers from which a risk level holds, fixed values.
RISKS = [(10, "CRITICAL"), (4, "HIGH"), (0, "MEDIUM")]


def trim_all(c: Column) -> Column:
    """c without white space at its ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The words of a text, split at any white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def tokenize_query(c: Column) -> Column:
    """Search tokens in order of first occurrence: each word, then its parts at '_' and at a change to
    upper case, all lower-cased, longer than one character and no stop words."""
    found = F.regexp_extract_all(c, F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    parts = F.flatten(F.transform(found, lambda w: F.concat(F.array(w), F.split(w, r"(?<=[a-z])(?=[A-Z])|_+"))))
    lower = F.transform(parts, lambda w: F.lower(w))
    return F.array_distinct(F.filter(lower, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def token_estimate(c: Column) -> Column:
    """Estimated tokens of a text: its words or a fourth of its code points rounded up, whichever is more; null and '' give 0."""
    t = F.coalesce(c, F.lit(""))
    return F.greatest(F.size(words(t)), F.floor((F.length(t) + 3) / 4).cast("int"))


def base_name(c: Column) -> Column:
    """What follows the last '.' of the trimmed text, unless that is its last character."""
    t = trim_all(c)
    return F.when(F.contains(t, F.lit(".")) & ~F.endswith(t, F.lit(".")), F.substring_index(t, ".", -1)).otherwise(t)


def directory_name(path: Column) -> Column:
    """The name of the directory that holds a path; '.' at the root."""
    return F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), -2)).otherwise(F.lit("."))


def imports_path(imp: Column, path: Column) -> Column:
    """Whether an import text matches a file's path: as its ending, within it (without a leading './'), or ending with its directory's name."""
    bare = F.regexp_replace(imp, r"^\./", "")
    return F.endswith(path, imp) | F.contains(path, bare) | F.endswith(imp, directory_name(path))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def skeleton(documentation: Column, signature: Column) -> Column:
    """The signature, below its documentation as a comment if there is one."""
    return F.when(_filled(documentation), F.concat(F.lit("/* "), documentation, F.lit(" */\n"), signature)).otherwise(signature)


def full_text(documentation: Column, signature: Column, body: Column) -> Column:
    """The skeleton with the body in braces."""
    return skeleton(documentation, F.concat(signature, F.lit(" {\n"), body, F.lit("\n}")))


def risk(callers: Column) -> Column:
    """The risk level of a number of affected callers."""
    return reduce(lambda w, r: w.when(callers > r[0], r[1]), RISKS[1:], F.when(callers > RISKS[0][0], RISKS[0][1])).otherwise("LOW")


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's last segment, '' if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def _by_extension(path: Column, table: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), extension(path)), F.lit(otherwise))


def detect_language(path: Column) -> Column:
    return _by_extension(path, LANGUAGES, "unknown")


def fence(path: Column) -> Column:
    return _by_extension(path, FENCES, "")


def is_test_file(path: Column) -> Column:
    """Whether a path is a test's; a directory counts only below another."""
    low = F.lower(path)
    rules = [F.endswith(low, F.lit(e)) for e in TEST_ENDINGS] + [F.contains(low, F.lit(p)) for p in TEST_PARTS]
    return reduce(lambda a, b: a | b, rules, F.startswith(F.substring_index(low, "/", -1), F.lit("test_")))


def is_ignored(path: Column, size: Column, extra: list[str] = (), max_kb: int = MAX_FILE_KB) -> Column:
    """Whether a scan leaves a relative path out: a segment with a leading dot or an ignored name (in any case), a binary
    extension, or more than max_kb (0: no limit). A null size counts as small."""
    names = sorted({*IGNORED_NAMES, *(n.lower() for n in extra)})
    hidden = F.exists(F.split(path, "/"), lambda s: (F.startswith(s, F.lit(".")) & ~s.isin(".", "..")) | F.lower(s).isin(names))
    large = F.coalesce(size, F.lit(0)) > max_kb * 1024 if max_kb > 0 else F.lit(False)
    return hidden | extension(path).isin(BINARY_EXTENSIONS) | large


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("::"), name)


def edge_id(src: Column, dst: Column, type_: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(":"), type_)


def location(path: Column, l1: Column, c1: Column, l2: Column, c2: Column) -> Column:
    return F.format_string("%s:%d:%d-%d:%d", path, l1, c1, l2, c2)


def location_valid(l1: Column, l2: Column) -> Column:
    return (l1 > 0) & (l2 >= l1)


def checksum(content: Column) -> Column:
    """SHA-256 of a content in hexadecimal."""
    return F.sha2(content, 256)
