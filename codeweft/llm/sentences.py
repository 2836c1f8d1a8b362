"""Sentence units of texts in many scripts, in SQL expressions.

A working copy of each text is masked character by character, so that every position stays: dots
of decimals, URLs, initials and abbreviations, and terminators inside quotation marks, brackets,
headings and code, become private-use placeholders. Where a unit ends at white space, one
character of it becomes a cut. The copy is split at cuts and after terminators of scripts without
spaces; the pieces' lengths give the units' places in the text as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Placeholders (private use): a cut, a masked dot, a list marker, a masked terminator, a line break inside a unit, a heading's or code's start.
CUT, DOT, MARK, HELD, LINE, HEAD = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"

#: White space, as characters. Fixed values.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Terminators that need no space after them, and those of scripts with spaces and letter case. Fixed values.
ANYWHERE = "。！？｡．।॥։።፧။؟۔"
SPACED = ".!?;;…‥"
#: What may close a sentence after its terminator, and what may open the next. Fixed values.
CLOSERS = "\"'”’“»›)\\]}*_`」』）】》〉］｝"
OPENERS = "\"'“„«‹‘(\\[{¿¡*_`—–「『（【《〈-"

#: Abbreviations that never end a sentence (a dot follows), also with a capital. Fixed values.
NEVER = """Dr Mr Mrs Ms Mx Messrs Prof Rev Hon Capt Lt Sgt Gov Supt St Mt Hr Hrn Frl Dipl Ing
e.g i.e cf vs viz approx ca circa resp bzw vgl ggf evtl sog inkl exkl zzgl bspw
Sra Srta Sres Dra Uds Vd aprox p.ej c.-à-d Mme Mlle MM
см напр проф акад βλ π.χ δηλ Δρ
डॉ श्री श्रीमती प्रो पं օր դոկտ""".split()
#: Abbreviations that end a sentence only if what follows begins one. Fixed values.
PERHAPS = """etc al Inc Ltd Co Corp Jr Bros Esq sec secs min mins hr hrs ft lb oz Sr Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
a.m p.m A.M P.M U.S U.K U.N E.U D.C Ph.D M.D B.A M.A usw usf Sek Std Min Jh Jhd u.a u.ä o.ä z.T ff f
EE.UU UU JJ с.ш г гг в вв сек мин др пр т.д т.п κ.λπ κ.ά μ.μ π.μ հազ""".split()
#: Abbreviations only before a number. Fixed values.
BEFORE_NUMBER = """No no Nos nos Nº nº n.º n N p P S s Inc Art art par Par Fig Figs Eq Eqs Sec Sect Ch Chap Vol Vols Ed App Tab Nr Abb Abschn Kap Bd
fig figs eq eqs sect ch chap vol vols pp pag pág págs núm cap tabl rif env apr рис табл гл стр ок тыс σελ αρ εικ πίν""".split()
#: Pairs written with a space, of which the first dot never ends a sentence; of the second list neither does the second. Fixed values.
PAIRS = "т|д т|п EE|UU FF|AA JJ|OO u|a i|d d|R a|m p|m и|др".split()
PAIRS_NEVER = "z|B d|h p|ex p|ej т|е i|e e|g o|ä s|o s|u z|T i|A u|U c|à".split()
#: Months and the like that follow an ordinal's dot. Fixed values.
AFTER_ORDINAL = """Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember
Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez Jahrhundert Jh Platz Kapitel Auflage Klasse Stock""".split()


def _some(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


_S = "[" + SPACES.replace("\\", "") + "]"
_BLANK = "[" + SPACES.replace("\n", "") + "]"
#: A word that is an identifier: snake or camel case, a call or a file name.
_IDENTIFIER = r"[\p{Ll}\p{N}]+(?:_[\p{L}\p{N}]|\p{Lu}|\()|[\p{Ll}\p{N}]+\.[a-z]{1,4}\b"
_NO_LETTER = r"(?<![\p{L}\p{M}\p{N}])"
#: Characters that open a quoted or bracketed stretch. While such stretches are sought they stand as a
#: contiguous range of placeholders, since a class of many single characters is matched slowly.
_MARKS = "(（[【「『《„“«»‹‘\"'`"
_RANGE = "".join(chr(0xE010 + i) for i in range(len(_MARKS)))
_M = dict(zip(_MARKS, _RANGE))


def _stretch(opens: str, closes: str, least: str = "*+") -> str:
    """From one mark to the other without either between, however long, in one paragraph."""
    return f"{opens}[^{opens}{closes}{CUT}]{least}{closes}"


def _nested(opens: str, closes: str, depth: int = 16) -> str:
    """From one mark to the other, however long, in one paragraph; up to `depth` levels of such stretches inside."""
    free = f"[^{opens}{closes}{CUT}]*+"
    return f"{opens}{free}(?:{_nested(opens, closes, depth - 1)}{free})*+{closes}" if depth else f"{opens}{free}{closes}"


#: Quoted or bracketed stretches of one unit; brackets and “” may nest. Fixed patterns.
_HELD = "|".join(
    [
        _nested(_M["("], "\\)"),
        _nested(_M["（"], "）"),
        _nested(_M["["], "\\]"),
        _nested(_M["【"], "】"),
        _nested(_M["「"], "」"),
        _nested(_M["『"], "』"),
        _nested(_M["《"], "》"),
        rf"{_M['„']}[^{_M['„']}{_M['“']}”{CUT}]*+[{_M['“']}”]",
        _nested(_M["“"], "”"),
        _stretch(_M["«"], _M["»"]),
        _stretch(_M["»"], _M["«"]),
        _nested(_M["‹"], "›"),
        _stretch(_M["‘"], "’") + r"(?!\p{L})",
        _stretch(_M['"'], _M['"'], "++"),
        rf"(?<![\p{{L}}\p{{N}}]){_M["'"]}(?! )[^{_M["'"]}{CUT}]++{_M["'"]}(?![\p{{L}}\p{{N}}])",
        _stretch(_M["`"], _M["`"], "++"),
    ]
)
_PIECE = f"(?s)[^{_RANGE[0]}-{_RANGE[-1]}]++|(?:{_HELD})|."


def _spans(c: Column, change) -> Column:
    """c with change() applied to each quoted or bracketed stretch; lengths stay."""
    pieces = F.regexp_extract_all(F.translate(c, _MARKS, _RANGE), F.lit(_PIECE), F.lit(0))
    held = lambda p: (F.length(p) > 1) & (F.instr(F.lit(_RANGE), F.substring(p, 1, 1)) > 0)
    return F.translate(F.array_join(F.transform(pieces, lambda p: F.when(held(p), change(p)).otherwise(p)), ""), _RANGE, _MARKS)


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def _hold(p: Column, marks: str) -> Column:
    return F.translate(p, marks, HELD * len(marks))


_TERMINATORS = ANYWHERE + SPACED
#: A fenced block, to its end or the text's.
_FENCE = r"(?<![^\n])[ \t]{0,3}(```+|~~~+)[^\n]*+(?:\n(?![ \t]{0,3}\1[`~]*[ \t]*(?:\n|\z))[^\n]*+)*+(?:\n[ \t]{0,3}\1[`~]*[ \t]*(?=\n|\z))?"


#: Private-use characters of a text itself are no placeholders.
_PRIVATE = "".join(map(chr, range(0xE000, 0xE020)))


#: A heading's line, and a line with the one that underlines it, if there is one.
_HEADING = r"(?<![^\n])[ \t]{0,3}#{1,6}[ \t][^\n]*+"
_LINE_UNDERLINED = r"[^\n]++(?:\n[ \t]*(?:={3,}|-{3,})[ \t]*(?=\n))?+"
_BULLETS = "-*+•‣◦▪"
#: A list number, as long as Markdown has it.
_NUMBER = r"\d{1,9}"


def _when(df: DataFrame, guard, change) -> DataFrame:
    """df with change() applied to those copies t for which guard() holds, which is quicker to tell."""
    t = F.col("t")
    return df.withColumn("t", F.when(guard(t), change(t)).otherwise(t))


def _has(*words: str):
    return lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])


def _like(pattern: str):
    return lambda t: F.rlike(t, F.lit(pattern))


def _headed(t: Column) -> Column:
    """Fences, headings and underlined headings as one line each, which begins with HEAD and ends with a cut."""
    line = lambda p: F.regexp_replace(_hold(F.translate(p, "\n", LINE), _TERMINATORS), "^([ \t]*+).", f"$1{HEAD}")
    parts = F.regexp_extract_all(t, F.lit(f"{_FENCE}|{_HEADING}|{_LINE_UNDERLINED}|\n"), F.lit(0))
    marked = lambda p: _has("#", "```", "~~~")(p) & F.rlike(p, F.lit(r"\A[ \t]{0,3}(?:```|~~~|#{1,6}[ \t])"))
    special = lambda p: (F.contains(p, F.lit("\n")) & (F.length(p) > 1)) | marked(p)
    t = F.array_join(F.transform(parts, lambda p: F.when(special(p), line(p)).otherwise(p)), "")
    return _sub(_sub(t, rf"({HEAD}[^\n]*+)\n", f"$1{CUT}"), rf"\n(?=[ \t]*{HEAD})", CUT)


#: What stands before a line. A pattern that begins with it, or with a look at the first character, passes others quickly.
_START = rf"(?:\A|[\n{CUT}])"


def _ended(t: Column) -> Column:
    """Marked list items with a cut at their line's end."""
    return _sub(t, rf"({MARK}[^\n{CUT}]*+)\n", f"$1{CUT}")


def _listed(df: DataFrame) -> DataFrame:
    """List items, marked and cut: bullets anywhere, numbers after a cut, another item or as 1."""
    bullet = rf"({_START}[ \t]*+)[{_BULLETS}](?=[ \t]+[^\n{CUT}])"
    df = _when(df, _like(rf"{_START}[ \t]*+[{_BULLETS}][ \t]"), lambda t: _ended(_sub(t, bullet, f"$1{MARK}")))
    number = rf"(?=[ \t(\d])((?:\G|(?<={CUT})|\A|(?<![^\n{CUT}])(?=[ \t]*+\(?1[.)]))[ \t]*+\(?{_NUMBER})[.)](?![ \t]+(?:{_some(AFTER_ORDINAL)})(?!\p{{L}}))([ \t]+[^\n{CUT}]*+[\n{CUT}])"
    df = _when(df, _like(rf"{_START}[ \t]*+\(?{_NUMBER}[.)][ \t]"), lambda t: _ended(_sub(t, number, f"$1{MARK}$2")))
    return _when(df, _has(MARK), lambda t: _sub(t, rf"\n(?=[ \t]*+\(?(?:{_NUMBER})?{MARK})", CUT))


def _structure(df: DataFrame) -> DataFrame:
    """The working copies t of texts t, with fences, headings, list items and blank lines cut out."""
    df = df.withColumn("t", F.concat("t", F.lit("\n")))
    df = _when(df, _like(f"[{_PRIVATE[0]}-{_PRIVATE[-1]}]"), lambda t: F.translate(t, _PRIVATE, "x" * len(_PRIVATE)))  # private-use characters of the text itself
    df = _when(df, _has("\r"), lambda t: _sub(_sub(t, "\r(?=\n)", " "), "\r", "\n"))
    df = _when(df, _has("```", "~~~", "#", "===", "---"), _headed)
    df = _when(df, _like(rf"\n{_BLANK}*+[\n{CUT}]"), lambda t: _sub(t, rf"\n(?={_BLANK}*+[\n{CUT}])", CUT))
    return _listed(df)


def _dots() -> str:
    """A dot that ends nothing. Each way begins with the dot, so that other characters are passed quickly."""
    pairs = [p.split("|") for p in PAIRS_NEVER]
    first = "|".join(rf"(?<={_NO_LETTER}{a}\.)(?={_S}{b}\.)" for a, b in [*pairs, *(p.split("|") for p in PAIRS)])
    never = [*NEVER, *(w[0].upper() + w[1:] for w in NEVER)]
    begins = rf"(?:[{OPENERS}]|{_S})*+(?:[\p{{Lu}}\p{{Lt}}¿¡]|{_IDENTIFIER}|[\p{{Lo}}&&[^\p{{IsArabic}}]])"
    ways = [
        rf"(?=[^\s{CUT}.!?…{CLOSERS}{SPACES}])",  # decimals, versions, URLs, file names
        rf"(?={_S}\p{{L}}{{1,2}}\.)(?:{first})",
        rf"(?<=[.]{_S}\p{{L}}{{1,2}}\.)(?={_S})(?<={_NO_LETTER}(?:{'|'.join(rf'{a}[.]{_S}{b}' for a, b in pairs)})\.)",
        rf"(?={_S}+\d)(?<={_NO_LETTER}(?:{_some(BEFORE_NUMBER)})\.)",
        rf"(?={_S}++(?!{begins})[^{CUT}])(?<={_NO_LETTER}(?:{_some(PERHAPS)})\.)",
        rf"(?={_S}+\p{{L}})(?<={_NO_LETTER}[\p{{Lu}}\p{{Lo}}]\p{{M}}?\.)",  # initials
        rf"(?<=\d\.)(?={_S}+(?:{_some(AFTER_ORDINAL)})(?![\p{{L}}]))",
        rf"(?={_S}+\p{{Lu}})(?<={_NO_LETTER}Sr\.)",
        rf"(?={_S})(?<={_NO_LETTER}(?:{_some(never)})\.)",
    ]
    return rf"\.(?:{'|'.join(ways)})"


def _masked(df: DataFrame) -> DataFrame:
    """The copies with dots that end nothing masked, and terminators inside quotes and brackets held."""
    df = _when(df, _has("."), lambda t: _sub(t, _dots(), DOT))
    held = lambda p: F.when(F.rlike(p, F.lit(_THAI)), _thai(_hold(p, _TERMINATORS), HELD)).otherwise(_hold(p, _TERMINATORS))
    return _when(df, _has(*_MARKS), lambda t: _spans(t, held))


_THAI = "[ก-ฺเ-๎]"
_GREEK = "[\u0370-\u03ff\u1f00-\u1fff]"


def _thai(t: Column, by: str) -> Column:
    return _sub(t, rf"[ \t\xa0](?<={_THAI}.)(?=[ \t\xa0]*+{_THAI})", by)


def _cuts(df: DataFrame) -> DataFrame:
    """The masked copies with a cut in the white space after each sentence."""
    upper = rf"[\p{{Lu}}\p{{Lt}}¿¡]"
    lower_after_dash = rf"(?!{_S}*[—–-]{_S}?\p{{Ll}})"
    df = _when(df, _like(rf"{_GREEK}[^;.!…{CUT}]*+[;\u037e]"), lambda t: _sub(t, rf"({_GREEK}[^;.!…{CUT}\u037e]*+)[;\u037e](?=\s|{CUT})", "$1?"))
    # a plain terminator ends a sentence whatever follows, but for a dash with a small letter
    df = df.withColumn("t", _sub(F.col("t"), rf"(?=[.!?\u2025-\u2026])(\.(?<![.\u2025-\u2026]\.)|[.\u2025-\u2026]*+[!?]+[.!?…]*)([{CLOSERS}]*+){lower_after_dash}{_S}(?!{_S}*[»])", f"$1$2{CUT}"))
    # dots of an ellipsis only if a capital follows
    df = _when(df, _has("..", "\u2025", "\u2026"), lambda t: _sub(t, rf"(?=[.\u2025-\u2026])([.\u2025-\u2026]{{2,}}|[\u2025-\u2026])([{CLOSERS}]*+){_S}(?={_S}*[{OPENERS}]*{upper})", f"$1$2{CUT}"))
    # a quotation or bracket that ends with a terminator, if what follows begins a sentence
    quote = rf"({HELD}{_S}?[{CLOSERS}]++){_S}"
    follows = rf"(?={_S}*(?:[{OPENERS}]*+(?:{upper}|\p{{N}}|{_IDENTIFIER})|[\"“„«—(\[]{_S}?[\p{{L}}\p{{N}}]))"
    df = _when(df, _has(HELD), lambda t: _sub(t, f"{quote}{follows}", f"$1{CUT}"))
    return _when(df, _like(_THAI), lambda t: _thai(t, CUT))


#: What stands for no character: after cuts, and after terminators of scripts without spaces.
POINT = "\ue006"


def _points(df: DataFrame) -> DataFrame:
    """The copies with a point after each terminator that needs no space, and its closers."""
    df = _when(df, _like(rf"(?=[\u0589-\uff61])[{ANYWHERE}]"), lambda t: _sub(t, rf"(?=[\u0589-\uff61])([{ANYWHERE}][{CLOSERS}!?]*+)(?![{ANYWHERE}…])", f"$1{POINT}"))
    eastern = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    df = _when(df, _like(f"[!?]{eastern}"), lambda t: _sub(t, rf"([!?])(?={eastern})", f"$1{POINT}"))
    return df.withColumn("t", F.replace("t", F.lit(CUT), F.lit(CUT + POINT)))


def units(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_char, end_char) of each sentence unit of each row's text.

    Positions are code points from 0, the end exclusive, without white space at either end;
    together the units cover all but white space. A null or blank text has none. Rows that
    repeat a key are split each for itself.
    """
    copy = documents.where("text is not null").select(key, F.monotonically_increasing_id().alias("row"), F.col("text").alias("t"))
    copy = _points(_cuts(_masked(_structure(copy))))
    pieces = copy.select(key, "row", F.posexplode(F.split("t", POINT, -1)).alias("i", "p"))
    blanks = F.lit(SPACES + CUT)
    left = F.length(F.ltrim(F.col("p"), blanks))
    sizes = pieces.select(
        key, "row", "i", F.length("p").alias("n"), (F.length("p") - left).alias("lead"), F.length(F.trim(F.col("p"), blanks)).alias("size")
    )
    before = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("lead")
    placed = sizes.select(key, start.alias("s"), "size").where("size > 0")
    return placed.select(key, F.col("s").cast("int").alias("start_char"), (F.col("s") + F.col("size")).cast("int").alias("end_char"))
