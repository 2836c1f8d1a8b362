"""Functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .islands import functions

_ISLANDS = "file_path string, line int, found_name string, found_signature string, found_doc string, found_body string"


def _task(with_body: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("rel_path").to_pylist(), b.column("content").to_pylist()):
                rows += [(path, line, name, sig, doc, body if with_body else "") for line, name, sig, doc, body in functions(path, content) if doc]
            names = ["file_path", "line", "found_name", "found_signature", "found_doc", "found_body"]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line" else pa.string()) for n, c in zip(names, columns)], names=names)

    return run


_DATE = r"(?:\d{4}[-/.]\d{1,2}(?:[-/.]\d{1,2})?|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
_NAMED = r"(?:(?:the |The )?(?:\p{Lu}[\p{L}\p{N}.'&-]*|<?[\w.+-]+@[\w.-]+>?|@[\w-]+|and|von|van|de)[\s,]*)+"
_TOKENS = r"(?:[\w@/.*-]+(?:\s*,\s*[\w@/.*-]+)*)"
_REASON = r"(?:\s*(?:--|//|#).*)?"
_LICENCE = r"\b(?:licen[cs]es?|mit|apache|bsd|[la]?gpl|mpl|isc|cc0|unlicense)\b"
#: Lines that tell nothing, whatever the function, matched in full. A directive counts in its own form only. Fixed patterns.
_NOISE = "|".join(
    [
        r"[\W_]*",  # blank lines and rulers
        r"[\W_]*(?:TODO|FIXME|XXX|HACK|TBD|WIP|todo|fixme|xxx|tbd|wip)\b.*",  # to-do marks
        r"[\W_]*(?i:todo|fixme|xxx|hack|tbd|wip)\s*(?:\([^()]*\)\s*)?:.*",
        r"[\W_]*(?i:n/?a|none|null|ditto|idem|same|same as (?:before|above|below)|as (?:the name|its name) (?:says|suggests|implies)|self[- ]?explanatory|obvious|trivial|no (?:comments?|description|docs?|documentation)(?: (?:yet|available|needed|provided|required|here|necessary))*|nothing to see here|doc|docs|documentation|placeholder|undocumented|stub|document me|documentation (?:is )?(?:pending|missing|(?:goes |comes )?here|to (?:follow|come))|(?:please )?(?:add|insert|write|put|enter|your) (?:an? |the |your |some )?(?:proper )?(?:description|documentation|docs?|comment|summary)s?(?: (?:here|later|soon|please|now|text|for (?:this|the) (?:function|method)|of (?:this|the) (?:function|method)))*|(?:description|summary|comment|docs?|documentation) (?:goes )?here|to be (?:documented|written|done|defined)(?: later| soon)?|missing (?:docs?|documentation)(?: here| comment)?|lorem ipsum.*|auto-?generated (?:method |function |constructor |catch )?(?:stub|block|comment|documentation)|(?:method|function|constructor) stub|not documented( yet)?|deprecated|internal(?: use only)?|see (?:above|below|code|source|implementation))[\W_]*",
        rf"[\W_]*(?i:(?:es|style)lint-(?:disable|enable|env|ignore)(?:-[a-z]+)*(?:\s+{_TOKENS})?|eslint\s+[\w@/-]+\s*:\s*\S+|(?:tslint|jshint|jslint):?\s*(?:disable|enable|ignore|[\w-]+\s*:)[\w\s:,-]*|prettier-ignore(?:-[a-z]+)?|(?:istanbul|c8|v8) ignore(?: (?:next|if|else|file|start|stop|line)(?: \d+)?)?|biome-ignore(?:-[a-z]+)?\s.*){_REASON}",
        rf"[\W_]*(?i:@ts-(?:ignore|nocheck|check|expect-error)\b.*|ts-(?:ignore|nocheck|expect-error)(?:\s*:.*)?|@(?:no)?flow(?: strict(?:-local)?)?|pragma:?\s*(?:no[- ]?(?:cover|branch|mutate)|once|warning\s+(?:disable|restore)[\s\w,]*)|noqa(?::\s*[a-z]+\d+(?:[\s,]+[a-z]+\d+)*)?|nolint(?::{_TOKENS})?|nosec(?:\s+[bg]\d+(?:[\s,]+[bg]\d+)*)?|nosonar|type:\s*ignore(?:\[[^\]]*\])?|fmt:\s*(?:on|off|skip)|(?:pylint|flake8|mypy|pyright|ruff|isort|yapf)\s*:\s*[\w-]+(?:\s*[=:]\s*{_TOKENS}|\[[^\]]*\])?)\W*{_REASON}",
        rf"[\W_]*(?i:noinspection)(?:\s+{_TOKENS})?\W*",
        r"[\W_]*(?:go:[a-z]+(?: .*)?|\+build(?:\s+[\w!,.]+)+)",
        rf"[\W_]*(?i:phpcs:\s*[a-z]+|@?(?:phpstan|psalm|phan)-[a-z-]+|rustfmt(?:::|-)\s*skip|clippy::\w+|clang-format (?:on|off)|clang-format:\s*\w+|checkstyle[.:]\s*(?:on|off)\b:?|(?:spotless|formatter):(?:on|off)|(?:swiftlint|rubocop|sonar|lint|golint|staticcheck|gosec):[a-z]\w*|@?codecoverageignore\w*|@?suppresswarnings\b(?:\s*\(.*\))?)(?:\s+{_TOKENS})?\W*{_REASON}",
        r"[\W_]*#\s*(?:end)?region\b.*|[\W_]*(?:end)?region[\W_]*|[\W_]*endregion\b.*",
        rf"[\W_]*(?:(?i:copyright)\s*(?i:\(c\)|©|:|,?\s*\d{{4}}|by\b).*|(?i:copyright)\s+{_NAMED}[\W_]*|(?:\([cC]\)|©)\s*(?i:copyright\s*)?(?:\d{{4}}|\p{{Lu}}).*|(?i:copyright)\b.*(?i:all rights reserved)[\W_]*|(?i:spdx-license-identifier\s*:.*|all rights reserved[\W_]*|(?:this (?:file|code|function|program|software) is )?(?:licensed|released|distributed|published) under\b.*{_LICENCE}.*|this (?:file|code|function|program|software) is (?:free software|distributed in the hope)\b.*|(?:the )?(?:apache|mit|bsd|mozilla|gnu|isc)(?: [\w.-]+){{0,3}} licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?[\d.]+)?[\W_]*|licen[cs]e\s*:\s*{_LICENCE}[\w\s.-]*)|(?i:licensed to)\s+(?:the\s+)?\p{{Lu}}.*|(?i:licen[cs]e)\s*:\s*\p{{Lu}}[\w.+-]*(?:\s+(?:[\p{{Lu}}\d][\w.+-]*|or|and))*\W*)",
        rf"[\W_]*(?:(?i:authors?|maintainers?|contributors?)\s*:\s*(?!(?:the|an?|of|who|that|which)\b)[^\s]+(?:\s+\S+){{0,3}}|(?i:authors?|maintainers?|contributors?|owners?|contact)\s*:?\s*{_NAMED}[\W_]*|(?i:created|written|generated|modified|last modified|reviewed|maintained|updated)\s+(?i:by)\s*:?\s*(?:{_NAMED}|(?i:the )?(?i:ide|intellij|vscode|team)\W*|\S+(?:\s+\S+){{0,3}}?\s*(?:,|-|\b(?:on|at)\b)?\s*{_DATE}.*))",
        rf"[\W_]*(?i:(?:since|version)\s*:?\s*v?\d[\w.+-]*|(?:date|created|last modified|last updated|updated|modified)(?: on)?\s*:?\s*{_DATE}[\d:\sTZ.]*)[\W_]*",
        r"[\W_]*(?i:example|examples|usage|args|arguments|parameters|params|returns?|raises|throws|errors|panics|safety|note|notes|see also|yields|attributes|output|input)\s*:?[\W_]*",
        r"\s*(?:>>> ?|\$ |\.\.\.\s{4}).*",  # a prompt
    ]
)
#: Words that stand beside another word in code. Fixed values.
_KEYWORDS = r"(?:return|new|await|throw|yield|var|let|const|int|string|bool|boolean|float|double|char|void|long|byte|mut|func|fn|def|function|class|struct|interface|enum|impl|type|extends|implements|public|private|protected|static|final|abstract|async|export|pub)\b"
#: No two words stand beside each other, but for keywords.
_NO_PROSE = rf"(?!.*?(?<![\w$.])(?!{_KEYWORDS})[\w$.]+\s+(?!{_KEYWORDS})[^\W\d])"
_MODIFIER = r"(?:(?:export|default|pub(?:\([^()]*\))?|public|private|protected|static|final|abstract|async|unsafe|override|readonly)\s+)*"
#: Lines that are syntax in full, without their string literals, matched in full. Fixed patterns.
_CODE = "|".join(
    [
        rf"\s*{_MODIFIER}(?:func|fn|def|function)\s*(?:\([^()]*\)\s*)?[\w$]+(?:<[^<>]*>|\[[^\[\]]*\])?\(.*\)(?:\s*->\s*[^\s{{:;]+|\s*:\s*[\w$.<>\[\]|]+|\s*\([^()]*\)|\s+[*\w.\[\]]+)?\s*(?:[:;]|\{{.*|:\s*(?:return|pass|raise|yield|\.\.\.).*)?",
        r"\s*class\s+\p{Lu}\w*(?:\([^()]*\))?:",
        r"\s*from\s+[\w.]+\s+import\s+[\w*]+(?:\s*,\s*\w+)*|\s*import\s+(?:static\s+)?[\w.*]+;|\s*import\s+.*(?:\bfrom\s+)?''\s*;?|\s*(?:package|use|using)\s+[\w.:\\]+;",
        rf"\s*{_MODIFIER}(?:(?:var|let|const|val|auto)\s+(?:mut\s+)?|(?:int|string|bool|boolean|float|double|char|long|byte|\p{{Lu}}[\w.<>\[\]]*)\s+)?[$\w.\[\]]+(?:\s*,\s*[$\w.]+)*(?:\s*:\s*[\w.<>\[\]]+)?\s*(?::=|[-+*/|&^%]?=(?!=))\s*{_NO_PROSE}\S.*",
        r"\s*(?:(?:private|public|protected|static|final|readonly)\s+)+[\w.<>\[\]]+\s+[$\w]+\s*;",
        rf"{_NO_PROSE}\s*(?:(?:await|return|new|throw|yield|go|defer|raise)\s+)*[\w$.>:-]+\(.*\)\s*[;:{{]?\s*(?:->\s*\S+)?",
        rf"{_NO_PROSE}(?=.*(?:=|\w[(\[]|\w\.\w|\+\+|--|::|->))\s*\S.*;\s*",
        rf"{_NO_PROSE}\s*(?:return|throw|break|continue|pass|goto|import|package|var|let|const|private|public|protected|static|int|string)\b.*;\s*",
        rf"\s*\}}?\s*(?:if|else|for|foreach|while|switch|do|try|catch|finally|match|loop)\b.*\{{\s*|\s*(?:if|for|while|switch|catch)\s*\(.*\)\s*(?:\{{.*|[^\s].*;)?|{_NO_PROSE}\s*(?:if|elif|while|with|except|else|try|finally)\b.*:\s*|\s*[\w$.<>, ]*\b(?:class|struct|interface|enum|trait|impl)\b[^.]*\{{\s*",
        rf"{_NO_PROSE}.*[{{}}]\s*",
    ]
)
#: Tags that tell nothing whatever follows, that stand alone, and whose argument names something and does not describe it. Fixed values.
_BARE_TAG = "|".join(
    [
        r"[\W_]*[@\\](?i:author|copyright|licen[cs]e|suppress\w*|todo|fixme|ts-\w+|codecoverageignore\w*|noinspection|covers|group|dataprovider)\b.*",
        r"[\W_]*[@\\](?i:internal|override|inheritdoc|api|access|public|private|protected|static|final|abstract|async|generator|class|constructor|function|method|test|ignore|hidden|hideconstructor|readonly|virtual|since|version|see|link|category|package|subpackage|memberof|name|alias|module|namespace|uses|var|type|typedef|template|implements|extends|augments|requires|fires|listens|kind|file)\b(?:\s+(?:\{[^{}]*\}|\S+)){0,2}\s*",
    ]
)
_TAG_HEAD = r"^[\W_]*(?:[@\\](?:param(?:eter)?|arg(?:ument)?|property|prop|tparam)\b(?:\[[^\]]*\])?\s*(?:\{[^}]*\}\s*|\b(?:string|int|bool|array|float|mixed|object|number|boolean|\w+\[\])\s+(?=\$))?[$&\w.\[\]=]*|[@\\](?:returns?|throws?|exception|raises?|yields?)\b\s*(?:\{[^}]*\})?|[@\\]\w+|:(?:param|type|return|returns|rtype|raises|arg)\b[^:]*:)\s*[-:]?\s*"
#: Words that add nothing to a name. Fixed values.
_FILLERS = """a an the this that these it its is are was be been does do did done of for to in on at by with from and or as
function functions func method methods helper helpers util utility routine procedure fn def implementation implements impl
description describe describes documentation document docs doc summary comment name named called call calls handler
object value values given new self this return returns returned result results param params parameter parameters args arguments
optional string int integer bool boolean number list array bytes void none null nil err error u64 str uint8array long byte double float mixed type context
can will may should would could must shall main entry point get gets set sets simple simply just here something some thing things stuff details detail here note notes deprecated internal tbd todo fixme see use used
method's function's here's placeholder stub generated auto autogenerated""".split()


def _words(c: Column) -> Column:
    """Word stems of a text, identifiers split."""
    spread = F.regexp_replace(c, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    words = F.filter(F.split(F.lower(spread), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "(?<=..)(?:ies|ied|ing|ys|es|ed|e|y|s)$", "")).otherwise(w))


def _stem(w: str) -> str:
    import re

    return re.sub("(?<=..)(?:ies|ied|ing|ys|es|ed|e|y|s)$", "", w) if len(w) > 3 else w


def informative(doc: Column, name: Column, signature: Column) -> Column:
    """Whether a documentation tells a reader something beyond name and signature.

    Lines that are blank, rulers, to-do marks, placeholders, directives, authorship, licences or
    code are dropped, tags are cut down to their descriptions, and of the rest some word must be
    neither in name or signature (identifiers split, endings ignored) nor a filler. Null: false.
    """
    lines = F.split(doc, r"\r\n|\r|\n")
    bare = lambda x: F.regexp_replace(x, r"\"[^\"]*\"|(?<!\w)'[^']*'(?!\w)|`[^`]*`", "''")
    kept = F.filter(lines, lambda x: ~F.rlike(x, F.lit(f"(?sU)^(?:{_NOISE}|{_BARE_TAG})$")) & ~F.rlike(bare(x), F.lit(f"(?sU)^(?:{_CODE})$")))
    told = F.array_join(F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, f"(?i){_TAG_HEAD}", " "), r"\{@\w+[^}]*\}", " ")), " ")
    known = F.array_union(_words(F.concat_ws(" ", name, signature)), F.lit(sorted({_stem(w) for w in _FILLERS} | set(_FILLERS))))
    rest = F.filter(F.array_except(_words(told), known), lambda w: ~F.rlike(w, F.lit(r"^\p{N}+$")))
    return F.coalesce(F.size(rest) > 0, F.lit(False))


def pairs(symbols: DataFrame, files: DataFrame, with_body: bool = True) -> DataFrame:
    """(symbol_id, file_path, name, documentation, signature, body, language) of each documented function or method.

    For Go, documentation and body come from the row, otherwise from the file's content at the
    declaration's line. Functions without body or with trivial documentation are left out, exact
    duplicate rows count once; a null kind, path or content gives no pair.
    """
    f = symbols.where("lower(trim(kind)) in ('function', 'method') and file_path is not null")
    f = f.select("symbol_id", "file_path", "name", "signature", "documentation", "body", "start_line").dropDuplicates(["symbol_id"])
    go = F.lower("file_path").endswith(".go")
    own = f.where(go & F.col("documentation").isNotNull() & (F.trim("body") != ""))
    if not with_body:
        own = own.withColumn("body", F.lit(""))

    code = files.where(~F.lower("rel_path").endswith(".go") & F.col("content").isNotNull()).select("rel_path", "content")
    islands = code.mapInArrow(_task(with_body), _ISLANDS)
    other = f.where(~go).drop("documentation", "body")
    joined = other.join(islands, (other.file_path == islands.file_path) & (other.start_line == islands.line) & (other.name == islands.found_name))
    joined = joined.select(
        "symbol_id", other.file_path, "name", F.coalesce("signature", "found_signature").alias("signature"), F.col("found_doc").alias("documentation"), F.col("found_body").alias("body")
    )
    every = own.select(joined.columns).unionByName(joined)
    every = every.where(informative(F.col("documentation"), F.col("name"), F.col("signature")))
    ext = F.lower(F.substring_index("file_path", ".", -1))
    return every.dropDuplicates(["symbol_id"]).withColumn("extension", ext)
