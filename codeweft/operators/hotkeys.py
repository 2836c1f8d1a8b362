"""Per-key totals that stay even when a few keys hold most rows.

Each input split encodes its keys in a dictionary and adds into dense accumulator arrays
(numpy bincount), so a key costs one partial row per split, however many rows it has. The
partial arrays are then summed block by block: keys are spread over reducers by hash and come
sorted by it, and each reducer scatter-adds the partials into its own dense arrays, which it emits
and begins anew once they are full, between two hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys that a task holds before it emits its arrays and starts new ones.
FLUSH_KEYS = 400_000


class _Accumulators:
    """A dictionary of keys and one dense array for each measure."""

    def __init__(self, measures: int):
        self.slots: dict = {}
        self.n = np.zeros(1024, np.int64)
        self.sums = [np.zeros(1024, np.float64) for _ in range(measures)]

    def add(self, keys: pa.Array, n: np.ndarray | None, measures: list[np.ndarray]) -> None:
        coded = keys.dictionary_encode("encode") if not isinstance(keys, pa.DictionaryArray) else keys
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        slots = self.slots
        place = np.fromiter((slots.setdefault(w, len(slots)) for w in words), np.int64, len(words))
        if len(slots) > len(self.n):
            size = 2 * len(slots)
            self.n = np.concatenate([self.n, np.zeros(size - len(self.n), np.int64)])
            self.sums = [np.concatenate([s, np.zeros(size - len(s))]) for s in self.sums]
        if n is None:
            self.n[place] += np.bincount(code, minlength=len(words))
        else:
            np.add.at(self.n, place[code], n)
        for total, m in zip(self.sums, measures):
            total[place] += np.bincount(code, weights=m, minlength=len(words))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        k = len(self.slots)
        columns = [pa.array(list(self.slots), pa.string()), pa.array(self.n[:k]), *[pa.array(s[:k]) for s in self.sums]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _task(measures: list[str], partial: bool):
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), *[(m, pa.float64()) for m in measures]])

    def parts(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        """The batch, in a reducer what stands before its last hash and the rest: the keys of the first part are complete."""
        if partial:
            return [b]
        h = b.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        return [b.slice(0, last), b.slice(last)] if last else [b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulators(len(measures))
        for whole in batches:
            for i, b in enumerate(parts(whole) if whole.num_rows else []):
                if i and len(acc.slots) > FLUSH_KEYS:
                    yield acc.batch(schema)
                    acc = _Accumulators(len(measures))
                values = [np.nan_to_num(b.column(m).to_numpy(zero_copy_only=False).astype(np.float64)) for m in measures]
                acc.add(b.column("key"), None if partial else b.column("n").to_numpy(), values)
            if partial and len(acc.slots) > FLUSH_KEYS:
                yield acc.batch(schema)
                acc = _Accumulators(len(measures))
        if acc.slots:
            yield acc.batch(schema)

    return run


def key_totals(df: DataFrame, key: str, measures: dict | None = None) -> DataFrame:
    """Rows (key, n, one sum per measure) of df, spread evenly whatever the skew.

    The null key is a key of its own (a row whose key is null). A null or NaN measure adds
    nothing. An empty table gives no rows. Other columns of df are not read.
    """
    names = list(measures or {})
    ddl = "key string, n bigint" + "".join(f", `{m}` double" for m in names)
    slim = df.select(F.col(key).cast("string").alias("key"), *[c.cast("double").alias(m) for m, c in (measures or {}).items()])
    partial = slim.mapInArrow(_task(names, True), ddl)
    spread = partial.withColumn("h", F.xxhash64("key")).repartition("h").sortWithinPartitions("h")
    return spread.mapInArrow(_task(names, False), ddl)


def hot_keys(totals: DataFrame, share: float = 0.02) -> DataFrame:
    """The keys of a totals table (written, since it is read twice) that hold at least `share` of all rows.

    The null key counts among all rows but is never named. At most 1/share rows result.
    """
    total = totals.agg(F.sum("n")).first()[0] or 0
    return totals.where(F.col("key").isNotNull() & (F.col("n") >= F.lit(share * total)))
