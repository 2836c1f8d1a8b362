"""Line parsers of five languages as DataFrame operations.

A file becomes a row for each line. Patterns tell what a line is; windows over a file's lines
carry what a parser must remember: the open class, package or namespace, and annotations waiting
for the next declaration. Only what a line contributes is shuffled, not the water between.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import trim_all

# The patterns below, the words after them and the indents are fixed values: results depend on them.
_DOTTED_CALL = r"\b([a-zA-Z0-9_$]+(?:\.[a-zA-Z0-9_$]+)*)\s*\("

PYTHON_IMPORT = r"^(?:from\s+([a-zA-Z0-9_.]+)\s+import|import\s+([a-zA-Z0-9_.]+))"
PYTHON_CLASS = r"^\s*class\s+([a-zA-Z0-9_]+)(?:\((.*?)\))?:"
PYTHON_DEF = r"^\s*(?:async\s+)?def\s+([a-zA-Z0-9_]+)\s*\((.*?)\)(?:\s*->\s*[^:]+)?:"
PYTHON_CALL = r"\b([a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)*)\s*\("
PYTHON_NO_CALL = "def class if for while with".split()

TS_IMPORT = r"(?:import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\))"
TS_ARROW = r"^(?:export\s+)?(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s+)?(?:\((.*?)\)|[a-zA-Z0-9_$]+)\s*(?::\s*[^=]+)?\s*=>"
TS_FUNCTION = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_$]+)\s*\((.*?)\)"
TS_CLASS = r"^(?:export\s+)?(?:abstract\s+)?class\s+([a-zA-Z0-9_$]+)(?:\s+extends\s+([a-zA-Z0-9_$]+))?(?:\s+implements\s+([a-zA-Z0-9_$,\s]+))?"
TS_INTERFACE = r"^(?:export\s+)?interface\s+([a-zA-Z0-9_$]+)(?:\s+extends\s+([a-zA-Z0-9_$,\s]+))?"
TS_TYPE = r"^(?:export\s+)?type\s+([a-zA-Z0-9_$]+)\s*="
TS_ENUM = r"^(?:export\s+)?enum\s+([a-zA-Z0-9_$]+)"
TS_METHOD = r"^\s*(?:public|private|protected|static|async|\*)*\s*([a-zA-Z0-9_$]+)\s*\((.*?)\)(?::\s*[^;{]+)?\s*\{?"
TS_NO_CALL = "function if for while switch".split()
TS_NO_METHOD = "if for switch return".split()

JAVA_PACKAGE = r"^package\s+([a-zA-Z0-9_.]+);"
JAVA_IMPORT = r"^import\s+(?:static\s+)?([a-zA-Z0-9_.*]+);"
JAVA_TYPE = r"^(?:(?:public|protected|private|abstract|static|final|sealed|non-sealed)\s+)*(class|interface|record|enum)\s+([a-zA-Z0-9_$]+)(?:<[^>]+>)?(?:\(.*?\))?(?:\s+extends\s+([a-zA-Z0-9_$,\s<>]+?))?(?:\s+implements\s+([a-zA-Z0-9_$,\s<>]+?))?(?:\s*\{|\s*$)"
JAVA_CONSTRUCTOR = r"^(?:(?:public|protected|private)\s+)?([a-zA-Z0-9_$]+)\s*\((.*?)\)(?:\s*throws\s+[a-zA-Z0-9_$,\s]+)?\s*\{?"
JAVA_METHOD = r"^(?:(?:public|protected|private|static|final|synchronized|abstract|default|native)\s+)*(?:<[^>]+>\s+)?([a-zA-Z0-9_$<>,\[\]]+)\s+([a-zA-Z0-9_$]+)\s*\((.*?)\)(?:\s*throws\s+[a-zA-Z0-9_$,\s]+)?\s*\{?"
JAVA_ANNOTATION = r"^@([a-zA-Z0-9_$]+)(?:\(.*?\))?"
JAVA_NO_CALL = "if for while switch catch synchronized".split()
JAVA_NO_METHOD = "if for while switch catch".split()
JAVA_NO_RESULT = "return throw new".split()

PHP_NAMESPACE = r"^namespace\s+([a-zA-Z0-9_\\]+);"
PHP_USE = r"^use\s+([a-zA-Z0-9_\\]+)(?:\s+as\s+([a-zA-Z0-9_$]+))?;"
PHP_TRAIT_USE = r"^\s*use\s+([a-zA-Z0-9_$,\s\\]+);"
PHP_TYPE = r"^(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+([a-zA-Z0-9_$]+)(?:\s+extends\s+([a-zA-Z0-9_$\\]+))?(?:\s+implements\s+([a-zA-Z0-9_$,\s\\]+))?"
PHP_FUNCTION = r"^(?:(?:public|protected|private|static|abstract|final)\s+)*function\s+([a-zA-Z0-9_$]+)\s*\((.*?)\)(?:\s*:\s*[^;{]+)?\s*\{?"
PHP_CALL = r"\b([a-zA-Z0-9_$]+(?:::[a-zA-Z0-9_$]+|->[a-zA-Z0-9_$]+)?)\s*\("
PHP_NO_CALL = "if for foreach while switch catch array isset empty".split()

RUST_USE = r"^\s*(?:pub\s+)?use\s+([^;]+);"
RUST_IMPL = r"^\s*impl(?:\s*<.*?>)?\s+(?:([a-zA-Z0-9_]+)\s+for\s+)?([a-zA-Z0-9_]+)"
RUST_STRUCT = r"^\s*(?:pub(?:\(.*?\))?\s+)?struct\s+([a-zA-Z0-9_]+)"
RUST_ENUM = r"^\s*(?:pub(?:\(.*?\))?\s+)?enum\s+([a-zA-Z0-9_]+)"
RUST_TRAIT = r"^\s*(?:pub(?:\(.*?\))?\s+)?trait\s+([a-zA-Z0-9_]+)"
RUST_FN = r"^\s*(?:pub(?:\(.*?\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([a-zA-Z0-9_]+)\s*(?:<.*?>)?\s*\((.*?)\)"



def _is(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(c, pattern, n)


def _list(c: Column) -> Column:
    """The trimmed parts of a comma-separated list, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), trim_all), lambda x: x != "")


def _starts(c: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in prefixes])


def _before(c: Column, mark: str) -> Column:
    """What stands before the first mark, trimmed."""
    return F.when(F.contains(c, F.lit(mark)), trim_all(F.substring_index(c, mark, 1))).otherwise(c)


@dataclass
class Grammar:
    """What the lines of a language are. Each rule is a condition on the line and its trimmed text, in order of precedence."""

    language: str
    skipped: Column
    #: name -> condition; a line is the first that holds.
    rules: dict[str, Column]
    #: Lines (by rule) that wait for a declaration, and those that leave the waiting ones alone.
    waiting: list[str] = field(default_factory=list)
    neutral: list[str] = field(default_factory=list)


def _line() -> Column:
    return F.col("line")


def _text() -> Column:
    return F.col("trimmed")


def _ctx() -> Column:
    return F.col("ctx")


def lines(files: DataFrame) -> DataFrame:
    """(file_path, version, line_no, line, trimmed) of files (file_path, content); a null content has none.

    version tells contents of one path apart; rows of a path that recurs are left to _once().
    """
    return files.where("content is not null and file_path is not null").select(
        "file_path", F.xxhash64("content").alias("version"), F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")
    ).select("file_path", "version", (F.col("i") + 1).alias("line_no"), "line", trim_all(F.col("line")).alias("trimmed"))


def _once(df: DataFrame) -> DataFrame:
    """The lines of one content of each path, each once. The exchange is that of the windows over a file's lines, so whole contents never move."""
    one = F.min("version").over(Window.partitionBy("file_path"))
    return df.withColumn("one", one).where("version = one").drop("one", "version").dropDuplicates(["file_path", "line_no"])


def _by_line(*keys: str):
    return Window.partitionBy("file_path", *keys).orderBy("line_no")


def _ruled(files: DataFrame, g: Grammar) -> DataFrame:
    kind = reduce(lambda w, r: w.when(r[1], r[0]), list(g.rules.items())[1:], F.when(*reversed(list(g.rules.items())[0])))
    ls = lines(files).where(~g.skipped).withColumn("rule", kind)
    # water keeps its place in the order, not its text
    return _once(ls.withColumn("line", F.when(F.col("rule").isNotNull(), _line())).withColumn("trimmed", F.when(F.col("rule").isNotNull(), _text())))


def _context(df: DataFrame, event: Column, name: str) -> DataFrame:
    """The last event before each line ('' at first); a null event changes nothing."""
    before = _by_line().rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit("")))


def _waiting(df: DataFrame, g: Grammar) -> DataFrame:
    """The trimmed waiting lines since the last line that took or dropped them."""
    ends = (~F.coalesce(F.col("rule").isin(*g.waiting, *g.neutral), F.lit(False))).cast("int")
    df = df.withColumn("bout", F.coalesce(F.sum(ends).over(_by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = F.when(F.col("rule").isin(*g.waiting), _text())
    return df.withColumn("held", F.collect_list(held).over(_by_line("bout").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _calls(pattern: str, dropped: list[str]) -> Column:
    return F.filter(F.regexp_extract_all(_line(), F.lit(pattern), F.lit(1)), lambda c: ~c.isin(dropped))


def _symbols(df: DataFrame, language: str, name: Column, qualified: Column, kind: Column, signature: Column, exported: Column, calls: Column, implements: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    ordinal = F.row_number().over(_by_line()) - 1
    return df.select(
        "file_path", ordinal.alias("ordinal"), name.alias("name"), qualified.alias("qualified_name"), kind.alias("kind"), F.lit(language).alias("language"), signature.alias("signature"),
        F.lit("").alias("documentation"), F.lit("").alias("body"), exported.alias("exported"), F.col("line_no").alias("start_line"), F.lit(0).alias("start_col"), F.col("line_no").alias("end_line"), F.lit(0).alias("end_col"),
        F.coalesce(calls, none).alias("calls"), F.coalesce(implements, none).alias("implements"),
    )


def _imports(df: DataFrame, imp: Column) -> DataFrame:
    kept = [c for c in df.columns if c == "version"]
    found = df.select("file_path", *kept, "line_no", imp.alias("imp")).where("imp <> ''")
    found = _once(found) if kept else found
    return found.select("file_path", (F.row_number().over(_by_line()) - 1).alias("pos"), "imp")


def _with_held(signature: Column) -> Column:
    return F.array_join(F.concat("held", F.array(signature)), "\n")


def _rule(*names: str) -> Column:
    return F.col("rule").isin(*names)


def python(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports). Decorators go before the signature; an indented def in an open class is a method, another closes it."""
    g = Grammar("python", F.startswith(_text(), F.lit("#")) | (_text() == ""), {"held": _starts(_text(), "@"), "class": _is(_line(), PYTHON_CLASS), "def": _is(_line(), PYTHON_DEF)}, ["held"])
    df = _ruled(files, g)
    inner = _starts(_line(), "    ", "\t")
    df = _context(df, F.when(_rule("class"), _group(_line(), PYTHON_CLASS, 1)).when(_rule("def") & ~inner, ""), "ctx")
    df = _waiting(df, g).where(_rule("class", "def"))
    a_class = _rule("class")
    name = F.when(a_class, _group(_line(), PYTHON_CLASS, 1)).otherwise(_group(_line(), PYTHON_DEF, 1))
    method = ~a_class & inner & (_ctx() != "")
    symbols = _symbols(
        df, "python", name, F.when(method, F.concat_ws(".", _ctx(), name)).otherwise(name), F.when(a_class, "class").when(method, "method").otherwise("function"),
        _with_held(F.when(a_class, _text()).otherwise(F.regexp_replace(_text(), ":$", ""))), ~F.startswith(name, F.lit("_")), _calls(PYTHON_CALL, PYTHON_NO_CALL), F.when(a_class, _list(_group(_line(), PYTHON_CLASS, 2))),
    )
    plain = lines(files).where(~g.skipped & ~_starts(_text(), "@"))
    return symbols, _imports(plain, F.concat(_group(_line(), PYTHON_IMPORT, 1), _group(_line(), PYTHON_IMPORT, 2)))


def typescript(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports) of TypeScript and JavaScript. An unindented line that declares nothing closes the class."""
    rules = {"arrow": _is(_text(), TS_ARROW), "function": _is(_text(), TS_FUNCTION), "class": _is(_text(), TS_CLASS), "interface": _is(_text(), TS_INTERFACE), "type": _is(_text(), TS_TYPE), "enum": _is(_text(), TS_ENUM), "close": ~_starts(_line(), " ", "\t"), "method": _starts(_line(), "  ", "\t") & _is(_text(), TS_METHOD)}
    g = Grammar("typescript", _starts(_text(), "//", "/*") | (_text() == ""), rules)
    df = _context(_ruled(files, g), F.when(_rule("class"), _group(_text(), TS_CLASS, 1)).when(_rule("close"), ""), "ctx")
    heads = {"arrow": TS_ARROW, "function": TS_FUNCTION, "class": TS_CLASS, "interface": TS_INTERFACE, "type": TS_TYPE, "enum": TS_ENUM, "method": TS_METHOD}
    name = reduce(lambda w, r: w.when(_rule(r[0]), _group(_text(), r[1], 1)), list(heads.items())[1:], F.when(_rule("arrow"), _group(_text(), TS_ARROW, 1)))
    df = df.where(_rule(*heads)).withColumn("name", name).where(~_rule("method") | ((_ctx() != "") & ~F.col("name").isin(TS_NO_METHOD)))
    name, method = F.col("name"), _rule("method")
    arrow = F.concat(F.substring_index(_text(), "=>", 1), F.lit("=>"))
    bases = F.when(_rule("class"), F.concat(F.filter(F.array(_group(_text(), TS_CLASS, 2)), lambda x: x != ""), _list(_group(_text(), TS_CLASS, 3))))
    symbols = _symbols(
        df, "typescript", name, F.when(method, F.concat_ws(".", _ctx(), name)).otherwise(name),
        F.when(_rule("arrow", "function"), "function").when(_rule("enum"), "type").otherwise(F.col("rule")),
        F.when(_rule("arrow"), trim_all(arrow)).when(_rule("function", "method"), _before(_text(), "{")).otherwise(_text()),
        F.when(method, ~_starts(name, "_", "#")).otherwise(_starts(_text(), "export")), F.when(_rule("arrow", "function", "method"), _calls(_DOTTED_CALL, TS_NO_CALL)), bases,
    )
    return symbols, _imports(lines(files).where(~g.skipped), F.concat(_group(_line(), TS_IMPORT, 1), _group(_line(), TS_IMPORT, 2)))


def java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports). Annotation lines go before the next signature; extends and implements both implement."""
    rules = {"package": _is(_text(), JAVA_PACKAGE), "import": _is(_text(), JAVA_IMPORT), "held": _is(_text(), JAVA_ANNOTATION), "type": _is(_text(), JAVA_TYPE), "member": _is(_text(), JAVA_CONSTRUCTOR) | _is(_text(), JAVA_METHOD)}
    g = Grammar("java", _starts(_text(), "//", "/*", "*") | (_text() == ""), rules, ["held"], ["package", "import"])
    df = _context(_ruled(files, g), F.when(_rule("type"), _group(_text(), JAVA_TYPE, 2)), "ctx")
    df = _context(df, F.when(_rule("package"), _group(_text(), JAVA_PACKAGE, 1)), "package")
    df = _waiting(df, g).where(_rule("type", "member"))
    made = _rule("member") & (_ctx() != "") & _starts(_line(), "  ", "\t") & (_group(_text(), JAVA_CONSTRUCTOR, 1) == _ctx())
    name = F.when(_rule("type"), _group(_text(), JAVA_TYPE, 2)).when(made, _ctx()).otherwise(_group(_text(), JAVA_METHOD, 2))
    df = df.withColumn("name", name).withColumn("made", made)
    is_method = _is(_text(), JAVA_METHOD) & ~F.col("name").isin(JAVA_NO_METHOD) & ~_group(_text(), JAVA_METHOD, 1).isin(JAVA_NO_RESULT)
    df = df.where(_rule("type") | F.col("made") | is_method)
    name, a_type = F.col("name"), _rule("type")
    word = _group(_text(), JAVA_TYPE, 1)
    inner = F.when(_ctx() != "", F.concat_ws(".", _ctx(), name)).otherwise(name)
    symbols = _symbols(
        df, "java", name, F.when(a_type, F.when(F.col("package") != "", F.concat_ws(".", "package", name)).otherwise(name)).otherwise(inner),
        F.when(a_type, word).otherwise("method"), _with_held(_before(_text(), "{")), _starts(_text(), "public"), _calls(_DOTTED_CALL, JAVA_NO_CALL),
        F.when(a_type, F.concat(_list(_group(_text(), JAVA_TYPE, 3)), _list(_group(_text(), JAVA_TYPE, 4)))),
    )
    plain = lines(files).where(~g.skipped & ~_is(_text(), JAVA_PACKAGE))
    return symbols, _imports(plain, _group(_text(), JAVA_IMPORT, 1))


def php(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports). 'use' imports outside a class and adds traits to the class inside; attribute lines go before the next signature."""
    comment = _starts(_text(), "//", "/*", "*") | (_starts(_text(), "#") & ~_starts(_text(), "#["))
    rules = {"namespace": _is(_text(), PHP_NAMESPACE), "held": _starts(_text(), "#["), "type": _is(_text(), PHP_TYPE), "use": _starts(_text(), "use "), "function": _is(_text(), PHP_FUNCTION)}
    g = Grammar("php", comment | _text().isin("", "<?php", "?>"), rules, ["held"], ["namespace", "use"])
    top = ~_starts(_line(), " ", "\t")
    df = _context(_ruled(files, g), F.when(_rule("type"), _group(_text(), PHP_TYPE, 2)).when(_rule("function") & top, ""), "ctx")
    df = _context(df, F.when(_rule("namespace"), _group(_text(), PHP_NAMESPACE, 1)), "space")
    traits = df.where(_rule("use") & (_ctx() != "")).select("file_path", "line_no", _ctx().alias("name"), F.explode(_list(_group(_text(), PHP_TRAIT_USE, 1))).alias("trait"))
    traits = traits.groupBy("file_path", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "trait"))), lambda x: x["trait"]).alias("traits"))
    uses = df.where(_rule("use") & (_ctx() == ""))
    df = _waiting(df, g).where(_rule("type", "function"))
    a_type = _rule("type")
    name = F.when(a_type, _group(_text(), PHP_TYPE, 2)).otherwise(_group(_text(), PHP_FUNCTION, 1))
    method = ~a_type & (_ctx() != "") & _starts(_line(), "  ", "\t")
    full = F.when(F.col("space") != "", F.concat_ws("\\", "space", name)).otherwise(name)
    bases = F.concat(F.filter(F.array(_group(_text(), PHP_TYPE, 3)), lambda x: x != ""), _list(_group(_text(), PHP_TYPE, 4)))
    symbols = _symbols(
        df, "php", name, F.when(a_type, full).when(method, F.concat_ws("::", _ctx(), name)).otherwise(name), F.when(a_type, _group(_text(), PHP_TYPE, 1)).when(method, "method").otherwise("function"),
        _with_held(_before(_text(), "{")), a_type | ~F.startswith(name, F.lit("_")) | (name == "__construct"), _calls(PHP_CALL, PHP_NO_CALL), F.when(a_type, bases),
    )
    first = F.row_number().over(Window.partitionBy("file_path", "name").orderBy("ordinal")) == 1
    joined = symbols.withColumn("first", first).join(traits, ["file_path", "name"], "left")
    added = F.when(F.col("first") & F.col("traits").isNotNull(), F.concat("implements", "traits")).otherwise(F.col("implements"))
    return joined.withColumn("implements", added).select(symbols.columns), _imports(uses, _group(_text(), PHP_USE, 1))


def rust(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports). An impl gives the type of the indented fns after it; no calls are read."""
    rules = {"impl": _is(_line(), RUST_IMPL), "struct": _is(_line(), RUST_STRUCT), "enum": _is(_line(), RUST_ENUM), "trait": _is(_line(), RUST_TRAIT), "fn": _is(_line(), RUST_FN)}
    g = Grammar("rust", _starts(_text(), "//", "/*"), rules)
    inner = _starts(_line(), "    ", "\t")
    # an indented fn outside an impl finds nothing to close, so only the unindented ones do
    df = _context(_ruled(files, g), F.when(_rule("impl"), _group(_line(), RUST_IMPL, 2)).when(_rule("fn") & ~inner, ""), "ctx").where(_rule("struct", "enum", "trait", "fn"))
    name = F.when(_rule("struct"), _group(_line(), RUST_STRUCT, 1)).when(_rule("enum"), _group(_line(), RUST_ENUM, 1)).when(_rule("trait"), _group(_line(), RUST_TRAIT, 1)).otherwise(_group(_line(), RUST_FN, 1))
    method = _rule("fn") & inner & (_ctx() != "")
    kind = F.when(_rule("struct"), "struct").when(_rule("enum"), "type").when(_rule("trait"), "interface").when(method, "method").otherwise("function")
    none = F.lit(None).cast("array<string>")
    symbols = _symbols(df, "rust", name, F.when(method, F.concat_ws("::", _ctx(), name)).otherwise(name), kind, F.when(_rule("fn"), _before(_text(), "{")).otherwise(_text()), _starts(_text(), "pub"), none, none)
    return symbols, _imports(lines(files).where(~g.skipped), trim_all(_group(_line(), RUST_USE, 1)))
