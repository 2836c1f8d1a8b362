"""Encoding of a corpus with a public byte-level tokenizer, and decoding.

The vocabulary file's path is a parameter; nothing is trained. Encoding runs over Arrow batches
in map tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The vocabulary of TESTDATA.md; every executor must see the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: What an id outside the vocabulary is decoded to: U+FFFD.
UNKNOWN = "\ufffd".encode()


def _tokenizer(path: str):
    """The tokenizer of a file, loaded once for each task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a text that looks like a special token is ordinary text
    t.no_truncation()
    t.no_padding()
    return t


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others are numbered from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _token_bytes(t) -> list[bytes]:
    """The bytes of each id."""
    table = byte_table()
    out = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def _char_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points that each token touches, from the tokens' sizes in bytes.

    A character split over tokens belongs to each of them.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # byte position to character
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return char_of[starts], char_of[ends - 1] + 1


def _encode_task(path: str, key: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        size_of = np.fromiter(map(len, _token_bytes(t)), np.int64) if offsets else None
        for b in batches:
            for at in range(0, b.num_rows, 256):  # keeps the encodings of a batch small
                part = b.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids = [np.asarray(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                columns = [part.column(key), pa.array(ids, pa.list_(pa.int32()))]
                names = [key, "ids"]
                if offsets:
                    spans = [_char_spans(x, size_of[i]) if len(i) else (i, i) for x, i in zip(texts, ids)]
                    columns += [pa.array([s.astype(np.int32) for s, _ in spans], pa.list_(pa.int32())), pa.array([e.astype(np.int32) for _, e in spans], pa.list_(pa.int32()))]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(documents: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids[, starts, ends]) of each row's text, without special tokens.

    starts and ends are code points, end exclusive. A null or empty text gives empty lists; a
    repeated key gives a row for each of its rows.
    """
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return documents.select(key, "text").mapInArrow(_encode_task(vocabulary, key, offsets), ddl)


def _decode_task(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _token_bytes(_tokenizer(path))
        for b in batches:
            texts = []
            for ids in b.column("ids").to_pylist():
                raw = b"".join([pieces[i] if i is not None and 0 <= i < len(pieces) else UNKNOWN for i in ids or []])
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return run


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of rows (key, ids), by the reversed byte table.

    Tokens are joined as bytes first, so that a character split over tokens is whole again; what
    is no whole character, as at the ends of a cut list, and an id that is null or outside the
    vocabulary become U+FFFD. A null list gives ''.
    """
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(_decode_task(vocabulary, key), f"`{key}` {kind}, text string")
