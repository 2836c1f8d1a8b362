"""Island grammars: documentation, annotations, signatures and balanced bodies of functions.

All other code is water: lines are skipped until one looks like a declaration of the file's
language; only what belongs to that declaration is read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

#: Languages by file extension, fixed values.
LANGUAGES = {
    "py": "python", "ts": "brace", "tsx": "brace", "js": "brace", "jsx": "brace", "mjs": "brace", "cjs": "brace",
    "java": "brace", "php": "brace", "rs": "rust", "go": "go",
}

_MODIFIERS = r"(?:(?:export|default|declare|public|private|protected|static|abstract|final|async|override|readonly|synchronized|native|strictfp|get|set)\s+)*"
_NAME = r"[\w$#]+"
#: What a declaration's line looks like, per grammar; group 1 is the name. Fixed patterns.
_DECLARATIONS = {
    "python": [re.compile(r"\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)")],
    "go": [re.compile(r"\s*func\s*(?:\([^)]*\)\s*)?(\w+)")],
    "brace": [
        re.compile(rf"\s*{_MODIFIERS}function\s*[&*]?\s*({_NAME})"),
        re.compile(rf"\s*{_MODIFIERS}(?:const|let|var)\s+({_NAME})\b[^;]*?="),
        re.compile(rf"\s*{_MODIFIERS}(?:<[^>(]*>\s*)?(?:[\w$.<>\[\],?&| ]+?\s+)?\*?\s*({_NAME})\s*(?:<[^>(]*>)?\s*\("),
        re.compile(rf"\s*{_MODIFIERS}({_NAME})\s*=\s*(?:async\s*)?\("),
    ],
}
#: Words that begin statements, not declarations. Fixed values.
_STATEMENTS = re.compile(
    r"\s*(?:if|else|for|foreach|while|switch|case|catch|return|throw|new|do|try|with|elif|except|raise|assert|yield|await|import|from|use|package|echo|print|match|let\s+mut)\b(?!\s*[(:=]?\s*\)?\s*\{?\s*$)"
)
_DOCSTRING = re.compile(r"\s*[rRuU]?(\"\"\"|'''|\"|')")
_ANNOTATION = {"brace": re.compile(r"\s*(?:@(?!interface\b)[\w.]+|#\[)"), "rust": re.compile(r"\s*#!?\["), "go": re.compile(r"(?!)"), "python": re.compile(r"(?!)")}
_INLINE_DOC = re.compile(r"\s*/\*\*(?!/)(.*?)\*/\s*(?=\S)")


def _strip_block(text: str) -> str:
    """A block comment without its frame."""
    body = re.sub(r"\A\s*/\*+!?|\*+/\s*\Z", "", text)
    return "\n".join(re.sub(r"^\s*\*(?!\*+\s*$) ?", "", line).rstrip() for line in body.split("\n")).strip()


#: Water that may hold brackets, and what counts outside of it: brackets, semicolons, arrows; a slash may begin a regular
#: expression, a backquote a template. Fixed patterns, per language.
_COMMON = r"//[^\n]*|/\*.*?(?:\*/|\Z)|[{}()\[\];]|=>"
_LINE_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_TOKENS = {
    "js": re.compile(rf"{_COMMON}|{_LINE_STRINGS}|`|/", re.S),
    "java": re.compile(rf"{_COMMON}|\"\"\"(?:\\.|[^\\])*?\"\"\"|{_LINE_STRINGS}", re.S),
    "php": re.compile(rf"{_COMMON}|\#(?!\[)[^\n]*|<<<[ \t]*([\"']?)(\w+)\1\r?\n.*?^[ \t]*\2\b|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S | re.M),
    "rust": re.compile(rf"{_COMMON}|(?<!\w)b?r(\#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "go": re.compile(rf"{_COMMON}|{_LINE_STRINGS}|`[^`]*`", re.S),
}
_TOKENS_OF = {"java": "java", "php": "php", "rs": "rust", "go": "go"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: What a slash that begins a regular expression follows.
_REGEX_AFTER = re.compile(r"(?:\A|[(,=:\[!&|?{};+*%~^<>-]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|yield|await))\Z")
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_NEST = re.compile(r"/\*|\*/")


def _regex_end(text: str, at: int) -> int:
    """Where the regular expression at a slash ends, or 0 if it is a division."""
    before = text[max(0, at - 200) : at].rstrip()
    m = _REGEX.match(text, at) if not before and at <= 200 or _REGEX_AFTER.search(before) else None
    return m.end() if m else 0


def _template_end(text: str, at: int) -> int:
    """Where the template that begins before `at` ends; its expressions may hold braces and templates."""
    open_ = ["`"]
    while open_ and (m := (_IN_TEMPLATE if open_[-1] == "`" else _TOKENS["js"]).search(text, at)):
        at, t = m.end(), m.group()
        if t == "`" and open_[-1] == "`":
            open_.pop()
        elif t in ("`", "${", "{"):
            open_.append(t)
        elif t == "}" and open_[-1] != "`":
            open_.pop()
    return at if not open_ else len(text)


class _Marks:
    """The brackets, ends and comments of a text, read once from its start to its end."""

    def __init__(self, text: str, language: str):
        self.text, pattern = text, _TOKENS[language]
        self.at: list[int] = []
        self.mark: list[str] = []
        #: For each bracket the place in the lists of its partner, or -1.
        self.partner: list[int] = []
        #: Where a closing bracket or a comment ends -> where it was opened.
        self.opened: dict[int, int] = {}
        stack, at = [], 0
        while m := pattern.search(text, at):
            t, begin, at = m.group(), m.start(), m.end()
            if t == "`" and language == "js":
                at = _template_end(text, at)
                continue
            if t == "/":
                at = _regex_end(text, begin) or at
                continue
            if t[:2] == "/*":
                if language == "rust":
                    at = self._nested_comment(begin)
                self.opened[at] = begin
                continue
            if t not in "{}()[];=>":
                continue
            k = len(self.at)
            self.at.append(begin)
            self.mark.append(t)
            self.partner.append(-1)
            if t in "{([":
                stack.append(k)
            elif t in _CLOSES:
                while stack and self.mark[stack[-1]] != _CLOSES[t] and t == "}" and self.mark[stack[-1]] != "{":
                    stack.pop()  # a brace closes what was left open inside
                if stack and self.mark[stack[-1]] == _CLOSES[t]:
                    j = stack.pop()
                    self.partner[j], self.partner[k] = k, j
                    self.opened[begin + 1] = self.at[j]

    def _nested_comment(self, begin: int) -> int:
        depth = 0
        for m in _NEST.finditer(self.text, begin):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def body(self, start: int) -> tuple[str, str] | None:
        """(signature, body) of the declaration at `start`, or None if it has no body."""
        text, arrow, last = self.text, -1, start
        k = bisect_left(self.at, start)
        while k < len(self.at):
            at, mark = self.at[k], self.mark[k]
            if arrow < 0 and _ends_between(text[last:at]):
                return None
            if mark == ";":
                return (text[start:arrow].strip(), text[arrow:at].strip()) if arrow >= 0 else None
            if mark == "=>":
                arrow = arrow if arrow >= 0 else at + 2
                last, k = at + 2, k + 1
                continue
            close = self.partner[k]
            if mark in _CLOSES and (close < 0 or close < k):  # the end of what is around
                return (text[start:arrow].strip(), text[arrow:at].strip()) if arrow >= 0 and text[arrow:at].strip() else None
            if mark == "{":
                end = self.at[close] + 1 if close >= 0 else len(text)  # cut off at the end of the file
                after = k + 1 if close < 0 else close + 1
                if arrow < 0 and close >= 0 and after < len(self.at) and self.mark[after] == "{" and not text[end : self.at[after]].strip():
                    k, last = after, end  # a type in braces before the body
                    continue
                if arrow < 0 or not text[arrow:at].strip():
                    return text[start:at].strip(), text[at:end]
            if close < 0:
                return None
            last, k = self.at[close] + 1, close + 1
            if arrow >= 0 and re.match(r"[ \t]*\n(?!\s*[.?:&|+*/%<>=,({\[-])", text[last : last + 400]):
                return text[start:arrow].strip(), text[arrow:last].strip()
        return (text[start:arrow].strip(), text[arrow:].strip()) if arrow >= 0 and text[arrow:].strip() else None


#: A line end inside a declaration: what stands before it, or what follows, shows that it goes on. Fixed patterns.
_GOES_ON_AFTER = re.compile(r"(?:\A|[=,:|&+*/?<>(-]|\b(?:throws|extends|implements|where|public|private|protected|static|abstract|final|async|function|fn|func|new|export|default|const))\s*\Z")
_GOES_ON = re.compile(r"\s*(?:\Z|[:=,|&?.<>+*/-]|(?:throws|extends|implements|where|use)\b)")


def _ends_between(gap: str) -> bool:
    """Whether a declaration ends at the first line end of a gap between its brackets."""
    line, end, rest = gap.partition("\n")
    return bool(end) and not (_GOES_ON.match(rest) or line.strip() and _GOES_ON_AFTER.search(re.sub(r"//.*", "", line)))


def _doc_above(lines: list[str], starts: list[int], marks: _Marks, at: int, grammar: str) -> str | None:
    """The doc comment that ends right above line `at`; annotation lines may stand between."""
    i = at - 1
    note = _ANNOTATION[grammar]
    while i >= 0:
        line = lines[i]
        if note.match(line):
            i -= 1
            continue
        begin = marks.opened.get(starts[i] + len(line.rstrip())) if line.rstrip().endswith((")", "]", "}")) else None
        j = bisect_right(starts, begin) - 1 if begin is not None else i  # perhaps the end of a longer annotation
        if j < i and note.match(lines[j]):
            i = j - 1
            continue
        break
    if i < 0:
        return None
    line = lines[i].strip()
    if line.startswith("///") and not line.startswith("////") and grammar in ("rust", "brace"):
        j = i
        while j >= 0 and re.match(r"\s*///(?!/)", lines[j]):
            j -= 1
        return "\n".join(re.sub(r"^\s*///\s?", "", x).rstrip() for x in lines[j + 1 : i + 1])
    end = starts[i] + len(lines[i].rstrip())
    begin = marks.opened.get(end) if line.endswith("*/") else None
    if begin is None or not re.match(r"/\*\*(?!/)", marks.text[begin:end]):
        return None
    line_start = marks.text.rfind("\n", 0, begin) + 1
    return None if marks.text[line_start:begin].strip() else _strip_block(marks.text[begin:end])


_PYTHON_NEXT = re.compile(r"\s*(?:async\s+)?(?:def|class)\s+\w+\s*[(:]")


def _python(lines: list[str], at: int) -> tuple[str, str, str] | None:
    """(signature, documentation, body) of the def at line `at`."""
    depth, i = 0, at
    while i < len(lines):
        if i > at and depth > 0 and _PYTHON_NEXT.match(lines[i]):  # the brackets never close
            return None
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "''", lines[i])
        code = code.split("#")[0]
        depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
        if depth <= 0 and re.search(r":\s*$", code):
            break
        if depth <= 0 and (one := re.match(r"(.*?\)\s*(?:->[^:]*)?):\s*(\S.*)$", lines[i])):
            doc = _DOCSTRING.match(one.group(2))
            return "\n".join([*lines[at:i], one.group(1)]).strip(), _python_doc([one.group(2)], 0) or "" if doc else "", one.group(2)
        i += 1
    else:
        return None
    if i >= len(lines):
        return None
    indent = len(lines[at]) - len(lines[at].lstrip())
    end = i + 1
    while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
        end += 1
    body = "\n".join(lines[i + 1 : end]).rstrip()
    if not body.strip():
        return None
    return "\n".join(lines[at : i + 1]).strip().rstrip(":"), _python_doc(lines, i + 1) or "", body


def _python_doc(lines: list[str], at: int) -> str | None:
    if at >= len(lines) or not (m := _DOCSTRING.match(lines[at])):
        return None
    quote = m.group(1)
    if len(quote) == 1:
        one = re.match(rf"\s*[rRuU]?{quote}((?:\\.|[^{quote}\\])*){quote}\s*(?:#.*)?$", lines[at])
        return one.group(1) if one else None
    rest = "\n".join([lines[at][m.end() :], *lines[at + 1 :]])
    end = rest.find(quote)
    if end < 0:
        return None
    return "\n".join(x.strip() for x in rest[:end].split("\n")).strip()


def functions(path: str, content: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(line, name, signature, documentation, body) of each function with a body in a file's content.

    line is 1-based; functions without a doc comment are left out, but in Python, where documentation is '' then.
    """
    grammar = LANGUAGES.get(path.rpartition(".")[2].lower())
    if not grammar:
        return
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    if grammar != "python" and "/**" not in text and "///" not in text:
        return
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    marks = _Marks(text, _TOKENS_OF.get(path.rpartition(".")[2].lower(), "js")) if grammar != "python" else None
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        inline = _INLINE_DOC.match(line) if grammar in ("brace", "rust") else None
        code = line[inline.end() :] if inline else line
        if grammar == "brace" and (note := re.match(r"\s*(?:@[\w.]+(?:\([^()]*\))?\s+|#\[[^\]]*\]\s*)+", code)):
            code = code[note.end() :]
        if code.lstrip().startswith(("//", "*", "/*", "#")):
            continue
        name = next((m.group(1) for p in _DECLARATIONS[grammar] if (m := p.match(code))), None)
        if not name or grammar == "brace" and _STATEMENTS.match(code):
            continue
        if grammar == "python":
            if got := _python(lines, i):
                yield i + 1, name, *got
            continue
        doc = _strip_block("/**" + inline.group(1) + "*/") if inline else _doc_above(lines, starts, marks, i, grammar)
        if doc and (got := marks.body(starts[i] + len(line) - len(code))):
            yield i + 1, name, got[0], doc, got[1]
