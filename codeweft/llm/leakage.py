"""Held-out items whose passages stand in documents.

Containment search by MinHash sketches of the small sets, in Spark joins:

1. Every passage of an item (15 words, or 30 characters of Chinese) is a set of shingles, put into
   a partition by its size and sketched by its smallest hashes. The sketches are a table of rows.
2. All documents are read once. A Bloom filter of the sketches, of a fixed largest size, lets only
   those stretches of a document pass that may hold a sketched shingle.
3. Stretches and sketches are joined on partition and shingle hash; hot shingles are split by a salt.
4. Pairs that agree on the offset between item and document are verified word by word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import BROADCAST_ROWS, Scratch, small

#: Words, or characters of an item in Chinese, that make a passage.
PASSAGE = {"word": 15, "char": 30}
#: One in so many may be replaced.
REPLACED = 7
#: Words or characters of a shingle.
SHINGLE = 5
#: Smallest hashes kept of a passage, by size partition. A passage with every seventh word replaced can keep
#: a single shingle, so that the sketches of these small sets hold them all; with less, passages are lost.
SKETCH = {"word": 11, "char": 26}
#: Tokens around a shingle that a verification needs: of any stretch that counts some part does that is no longer.
#: (If no cut between two equal words leaves a part that counts, every second word is unequal but for a passage at
#: each end, and one in REPLACED allows that for less than these.)
REACH = {"word": 48, "char": 96}
#: Bits of the filter for each sketched shingle, and at most (16 MB).
FILTER_BITS, FILTER_MOST = 64, 1 << 27
#: Pieces in which shingles are joined where the sketches are too many to be broadcast.
SALTS = 16

_HAN = "㐀-䶿一-鿿豈-﫿"
#: Comments, scripts and styles whole, and tags of any length: attributes may run over lines and hold '>' in quotes.
_TAG = re.compile(
    r"<(script|style)\b[^<>]*>.*?</\1\s*>|<[A-Za-z][\w:.-]*+(?:\s+[^\s\"'<>/=]++(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]++))?)*+\s*/?>|</[A-Za-z][\w:.-]*+\s*>|<[/!?]?[A-Za-z][^<>\n]*>",
    re.S | re.I,
)
_LINK_END = r"\]\(\s*(?:<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))*+)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)"
_IMAGE = re.compile(rf"!\[[^\[\]]*(?:{_LINK_END}|\]\[[^\[\]\n]*\])")
#: What is not shown of links: Markdown targets, reference labels and their definitions, footnote marks, wiki and Org targets; tags of BBCode and LaTeX.
_LINK = re.compile(
    rf"(?m){_LINK_END}|^[ \t>]{{0,9}}\[[^\[\]\n]+\]:[ \t]+\S+(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$|\[\^[^\[\]\s]+\]|\]\[[^\[\]\n]*\](?!\])|\[\[[^\[\]|\n]*(?:\||\]\[)"
    r"|\[/?(?:b|i|u|s|quote|code|url|color|size|font|img|center|email)(?:=[^\[\]\n]*)?\]|\\(?:[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?)(?=\{)|\\href\{[^{}\n]*\}"
)
_MARKER = re.compile(r"(?m)^[ \t>]*(?:[-*+•]|\(?\d{1,9}[.)]|#{1,6})[ \t]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐¬][ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_CHAR = re.compile(r"[^\W_]")
#: Combining marks and invisible characters.
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")
_ANY_HAN = re.compile(f"[{_HAN}]")


def _shown(text: str) -> str:
    """Text without comments, tags and the parts of links that are not shown."""
    if "<" in text:
        end = text.rfind("-->") + 3
        text = re.sub(r"<!--.*?-->", " ", text[:end], flags=re.S) + text[end:] if end > 2 else text
        text = _TAG.sub(" ", text)
    return _LINK.sub(" ", text) if "[" in text or "\\" in text else text


def _readings(text: str) -> list[str]:
    """The plain forms of a text: as it is shown, and if they differ without its images, and with its markup as text."""
    if "&" in text:
        text = html.unescape(text)
    forms = [_shown(text)]
    if "![" in text:
        forms.append(_shown(_IMAGE.sub(" ", text)))
    return [_plain(t) for t in dict.fromkeys([*forms, text])]


def _plain(text: str) -> str:
    """Text without differences of case, character form, accents and invisible characters."""
    text = _BROKEN.sub("", _MARKER.sub(" ", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _UNSEEN.sub("", text)
    return text.casefold()


def _codes(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each token."""
    import xxhash

    known = {t: xxhash.xxh64_intdigest(t) for t in set(tokens)}
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _shingles(codes: np.ndarray) -> np.ndarray:
    """The hash of each run of SHINGLE tokens."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _sketched(h: np.ndarray, kind: str) -> np.ndarray:
    """Positions of the shingles that are among the SKETCH smallest of some passage."""
    width, most = PASSAGE[kind] - SHINGLE + 1, SKETCH[kind]
    if width <= most:
        return np.arange(len(h))
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    least = np.argpartition(windows, most - 1, axis=1)[:, :most] + np.arange(len(windows))[:, None]
    return np.unique(least)


def _tokens(kind: str, plain: str) -> list[str]:
    return (_CHAR if kind == "char" else _WORD).findall(plain)


def _kind(plain: str) -> str:
    letters = _CHAR.findall(plain)
    return "char" if 2 * len(_ANY_HAN.findall(plain)) > len(letters) else "word"


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SKETCHES = pa.schema([("item_id", pa.int64()), ("part", pa.string()), ("codes", _LONGS), ("h", _LONGS), ("at", _INTS)])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (item_id, text) as (item_id, part, codes, h, at): their words' codes and their passages' sketches."""
    for b in batches:
        out: list[list] = [[] for _ in _SKETCHES]
        for item_id, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            plain = _readings(text)[0]
            kind = _kind(plain)
            codes = _codes(_tokens(kind, plain))
            if len(codes) < PASSAGE[kind]:
                continue
            h = _shingles(codes)
            at = _sketched(h, kind)
            for c, v in zip(out, (item_id, kind, codes.view(np.int64), h[at].view(np.int64), at.astype(np.int32))):
                c.append(v)
        yield _batch(out, _SKETCHES)


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits of hashes; _slot() is the same in SQL."""
    mask = np.uint64(bits - 1)
    return [(h >> np.uint64(k)) & mask for k in (0, 18, 37)]


def _slot(h: Column, bits: int) -> Column:
    return F.explode(F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in (0, 18, 37)]))


def _filter(sketches: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the sketches' hashes: at most FILTER_MOST bits, however many there are."""
    bits = min(FILTER_MOST, max(1 << 15, 1 << (FILTER_BITS * rows - 1).bit_length()))
    slots = sketches.select(_slot(F.col("h"), bits).alias("slot")).selectExpr("slot + 1 as slot")  # the bitmap functions count from 1
    page = F.expr("bitmap_bucket_number(slot)").alias("page")  # pages of 4096 bytes
    pages = slots.groupBy(page).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    found = pages.agg(F.collect_list(F.struct("page", "bits")).alias("pages")).first()["pages"]
    whole = np.zeros(bits // 8, np.uint8)
    for p in found:
        at = (p["page"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)
    return whole


def _may_hold(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the hashes that pass the filter."""
    at = np.arange(len(h))
    for slot in _slots(h, 8 * len(bitmap)):
        s = slot[at].astype(np.int64)
        # a slot's bit, as bitmap_bit_position counts within its page
        at = at[(bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1]
    return at


def _stretches(tokens: list[str], kind: str, bitmap: np.ndarray) -> Iterator[tuple]:
    """(codes, positions in them, hashes) of the stretches of a document that may hold a sketched shingle."""
    if len(tokens) < PASSAGE[kind]:
        return
    codes = _codes(tokens)
    h = _shingles(codes)
    hits = _may_hold(h, bitmap)
    if not len(hits):
        return
    reach = REACH[kind]
    for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
        begin = max(0, part[0] - reach)
        yield codes[begin : part[-1] + SHINGLE + reach].view(np.int64), (part - begin).astype(np.int32), h[part].view(np.int64)


def _scan(bitmap, kind_of_key: pa.DataType):
    schema = pa.schema([("doc", kind_of_key), ("part", pa.string()), ("codes", _LONGS), ("pos", _INTS), ("h", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                for plain in _readings(text):
                    for kind in PASSAGE if _ANY_HAN.search(plain) else ("word",):
                        for codes, pos, h in _stretches(_tokens(kind, plain), kind, bits):
                            for c, v in zip(out, (doc, kind, codes, pos, h)):
                                c.append(v)
            yield _batch(out, schema)

    return run


def _holds(item: np.ndarray, doc: np.ndarray, shift: int, need: int) -> bool:
    """Whether at this offset a stretch of `need` or more begins and ends equal, with at most one in REPLACED unequal."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b - a < need:
        return False
    same = item[a:b] == doc[a + shift : b + shift]
    if same.sum() < need - need // REPLACED:
        return False
    g = REPLACED * np.r_[0, np.cumsum(~same)] - np.arange(len(same) + 1)
    first = np.maximum.accumulate(np.where(same, g[:-1], np.iinfo(np.int64).min))
    ends = np.flatnonzero(same)
    ends = ends[ends >= need - 1]
    return bool((g[ends + 1] <= first[ends - need + 1]).any())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (doc, item_id, part, codes, item_codes, shift) that hold a passage."""
    for b in batches:
        both = [b.column(c) for c in ("item_codes", "codes")]
        values, spans = [c.values.to_numpy() for c in both], [c.offsets.to_numpy() for c in both]
        kept = []
        for i, (part, shift) in enumerate(zip(b.column("part").to_pylist(), b.column("shift").to_pylist())):
            item, doc = (v[o[i] : o[i + 1]] for v, o in zip(values, spans))
            if _holds(item, doc, shift, PASSAGE[part]):
                kept.append(i)
        yield b.select(["doc", "item_id"]).take(pa.array(kept, pa.int32()))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id) of each document whose text holds a passage of an item's text.

    Null texts and items shorter than a passage hold nothing; an item id with several texts has
    the passages of each; without items, or documents, there are no rows. Documents are read once,
    whatever the number of items.
    """
    spark, s = documents.sparkSession, Scratch(documents.sparkSession, "leaks")
    asked = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    sketched = s.cut(asked.mapInArrow(_sketch, "item_id bigint, part string, codes array<bigint>, h array<bigint>, at array<int>").withColumn("item", F.monotonically_increasing_id()))
    sketches, n = s.cut_counting(sketched.select("item", "part", F.inline(F.arrays_zip("h", "at"))))

    bitmap = spark.sparkContext.broadcast(_filter(sketches, n["rows"]))
    docs = documents.where("text is not null").select(F.col(key).alias("doc"), "text")
    kind = docs.schema["doc"].dataType
    found = docs.mapInArrow(_scan(bitmap, to_arrow_type(kind)), f"doc {kind.simpleString()}, part string, codes array<bigint>, pos array<int>, h array<bigint>")
    found = s.cut(found.withColumn("row", F.monotonically_increasing_id()))

    hits = found.select("row", "part", F.inline(F.arrays_zip("h", "pos")))
    if n["rows"] <= BROADCAST_ROWS:
        pairs = hits.join(F.broadcast(sketches), ["part", "h"])
    else:  # a shingle that many items or documents have is joined in pieces
        salted = sketches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = hits.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["part", "h", "salt"])
    pairs = pairs.select("row", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    texts = small(sketched.select("item", "item_id", F.col("codes").alias("item_codes")), n["rows"])  # an item's codes are few more than its sketched shingles
    checked = pairs.join(found.select("row", "doc", "part", "codes"), "row").join(texts, "item")
    return checked.mapInArrow(_verify, f"doc {kind.simpleString()}, item_id bigint").distinct().withColumnRenamed("doc", key)
