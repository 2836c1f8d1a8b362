"""Import texts matched to file paths of the same repository.

A text matches a path that contains it (without a leading './') or whose directory's name ends
it. Neither is an equality, so each repository's paths are held, in blocks of bounded size, as a
sorted array of their suffixes, in which batches of texts are found by binary search. Where a
repository has several blocks, a text goes only to those that may match it: the blocks of paths
that hold the text's last characters, or a directory name that ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS

#: Paths of one repository that share a block.
BLOCK_PATHS = 4096
#: Lengths of the pieces by which the blocks of a text are found; a text takes the longest that it has.
PIECES = [1, 2, 4, 8, 16, 32, 64]
#: Candidates that a task holds before it hands matches on, or those of one text.
PAIRS = 50_000


def _after(x: str) -> str:
    """The first string after all that begin with x, or '' if there is none."""
    x = x.rstrip("\U0010ffff")
    return x and x[:-1] + chr(ord(x[-1]) + 1)


class _Paths:
    """Sorted suffixes of a block of paths, and the sorted names of their directories."""

    def __init__(self, paths: list[str]):
        self.paths = np.array(paths, object)
        ends = sorted((p[i:], k) for k, p in enumerate(paths) for i in range(max(len(p), 1)))
        self.suffix = np.array([s for s, _ in ends], object)
        self.owner = np.array([k for _, k in ends], np.int64)
        parts = [p.rsplit("/", 2) for p in paths]
        dirs = sorted(("." if len(x) == 1 else x[-2] or "/", k) for k, x in enumerate(parts))
        self.dir = np.array([d for d, _ in dirs], object)
        self.dir_owner = np.array([k for _, k in dirs], np.int64)
        self.dir_lengths = sorted({len(d) for d, _ in dirs})

    def _ranges(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first, last, owners): for each text, ranges of owners whose paths match."""
        bare = [t.removeprefix("./") for t in texts]
        after = np.array([_after(x) for x in bare], object)
        last = np.searchsorted(self.suffix, after)
        yield np.searchsorted(self.suffix, np.array(bare, object)), np.where(after == "", len(self.suffix), last), self.owner
        for n in self.dir_lengths:
            ends = np.array([t[len(t) - n :] if len(t) >= n else "" for t in texts], object)  # no name is empty
            yield np.searchsorted(self.dir, ends), np.searchsorted(self.dir, ends, "right"), self.dir_owner

    def probe(self, texts: list[str], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, path) of texts and paths that match, each pair once, or `most` of each text's."""
        ranges = list(self._ranges(texts))
        total = np.cumsum(sum(last - first for first, last, _ in ranges))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            pairs = []
            for first, last, owners in ranges:
                n = (last - first)[a:b]
                rows = np.repeat(np.arange(a, b), n)
                at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + first[rows]
                pairs.append(rows * len(self.paths) + owners[at])
            pair = np.unique(np.concatenate(pairs))
            rows = pair // len(self.paths)
            if most is not None:
                kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
                pair, rows = pair[kept], rows[kept]
            yield rows, pair % len(self.paths)
            a = b


def _task(most: int | None):
    def answers(repo: str, paths: _Paths, texts: list[str]) -> Iterator[pa.RecordBatch]:
        words = np.array(texts, object)
        for rows, owners in paths.probe(texts, most):
            if len(rows):
                columns = [np.full(len(rows), repo, object), words[rows], paths.paths[owners]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["repo", "text", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, paths, index = None, [], None
        for b in batches:
            asked: list[str] = []
            for repo, block, ref, word in zip(*(b.column(c).to_pylist() for c in ("repo", "block", "is_ref", "text"))):
                if (repo, block) != current:
                    if asked:
                        yield from answers(current[0], index, asked)
                    current, paths, index, asked = (repo, block), [], None, []
                if not ref:
                    paths.append(word)
                    continue
                index = index or _Paths(paths)
                asked.append(word)
            if asked:
                yield from answers(current[0], index, asked)

    return run


def _hash(piece: Column) -> Column:
    return F.xxhash64("repo", piece)


def _name(path: str) -> Column:
    """The name of a path's directory."""
    above = F.regexp_extract(path, r"(?s)\A(?:.*/)?([^/]*)/[^/]*\z", 1)
    return F.when(~F.contains(path, F.lit("/")), ".").when(above == "", "/").otherwise(above)


def _where_to(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(repo, block, text): the blocks of held (repo, block, path) that may match each text (repo, text), each once."""
    bare = F.when(F.startswith("text", F.lit("./")), F.expr("substring(text, 3)")).otherwise(F.col("text"))
    n = F.lit(0)
    for k in PIECES:
        n = F.when(F.length("x") >= k, k).otherwise(n)
    inner = texts.withColumn("x", bare).withColumn("n", n).select("repo", "text", "n", _hash(F.right("x", F.col("n"))).alias("h"))
    sizes = held.groupBy("repo").agg(F.collect_set(F.length(_name("path"))).alias("ns"))  # no more than the longest name has characters
    outer = texts.join(sizes, "repo").withColumn("n", F.explode("ns")).where("length(text) >= n").select("repo", "text", _hash(F.right("text", F.col("n"))).alias("h"))

    asked = inner.groupBy("repo").agg(F.collect_set("n").alias("ns"))  # at most as many as PIECES, and none
    last = F.when(F.col("n") == 0, 1).otherwise(F.length("path") - F.col("n") + 1)
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: _hash(F.substring(F.col("path"), i, F.col("n")))))
    there = held.join(asked, "repo").withColumn("n", F.explode("ns")).where("length(path) >= n").select("repo", "block", F.explode(pieces).alias("h"))
    keys = inner.select("h").distinct()
    if keys.count() <= BROADCAST_ROWS:  # eight bytes each
        there = there.join(F.broadcast(keys), "h", "left_semi")
    named = held.select("repo", "block", _hash(_name("path")).alias("h"))
    by_piece = there.distinct().join(inner.select("repo", "text", "h"), ["repo", "h"])
    by_name = named.distinct().join(outer, ["repo", "h"])
    return by_piece.unionByName(by_name).select("repo", "block", "text").distinct()


def matches(texts: DataFrame, paths: DataFrame, most: int | None = None, block_paths: int = BLOCK_PATHS) -> DataFrame:
    """(repo, text, path) for distinct texts (repo, text) and distinct paths (repo, path).

    With `most`, each block gives at most so many paths of a text: enough to tell whether one
    besides the importing file itself is matched. Nulls match nothing; an empty text,
    or './' alone, matches every path of its repository.
    """
    texts, paths = texts.where("repo is not null and text is not null"), paths.where("repo is not null and path is not null")
    there = paths.join(texts.select("repo").distinct(), "repo", "left_semi")
    blocks = there.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / block_paths).cast("int").alias("blocks"))
    held = there.join(blocks, "repo").select("repo", F.pmod(F.xxhash64("path"), "blocks").cast("int").alias("block"), "path", "blocks")
    asked = texts.join(blocks.where("blocks = 1"), "repo").select("repo", F.lit(0).alias("block"), "text")
    if (blocks.agg(F.max("blocks")).first()[0] or 0) > 1:
        several = blocks.where("blocks > 1").select("repo")
        asked = asked.unionByName(_where_to(texts.join(several, "repo", "left_semi"), held.where("blocks > 1").select("repo", "block", "path")))
    both = held.select("repo", "block", F.lit(0).alias("is_ref"), F.col("path").alias("text")).unionByName(asked.select("repo", "block", F.lit(1).alias("is_ref"), "text"))
    return both.repartition("repo", "block").sortWithinPartitions("repo", "block", "is_ref").mapInArrow(_task(most), "repo string, text string, path string")
