"""References to records that do not exist.

Keys are range-partitioned by their 64-bit hash, into as many ranges as the rows ask for. In each
range the parents are kept as sorted arrays (hash, key, valid from, running maximum of valid to)
and batches of references are probed by vectorised binary search. A range that holds too many
rows is split in both directions: its references by a salt, and its parents by another, so that a
hot key loads no single task, whichever side has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..session import Scratch
from . import imports

#: Rows for which a range of the hash space is made, and the number of either side's rows beyond which it is split.
RANGE_ROWS, SPLIT_ROWS = 50_000, 100_000
#: Bits of the hash that the histogram tells apart: the most ranges there can be, and rows that are broadcast.
ZONE_BITS = 16

_FOREVER = (1 << 63) - 1


class _Parents:
    """Sorted arrays of one range."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        self.h = t.column("h").to_numpy()
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        self.key = t.column("key").combine_chunks()
        if isinstance(self.key, pa.ChunkedArray):
            self.key = pa.concat_arrays(self.key.chunks)
        code = self.key.dictionary_encode().indices.to_numpy().astype(np.int64)
        order = np.lexsort((lo, code, self.h))
        self.h, self.lo, hi, code = self.h[order], lo[order], hi[order], code[order]
        self.key = self.key.take(pa.array(order))
        self.start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        self.end = np.r_[self.start[1:], len(code)]
        self.start_h = self.h[self.start]
        # the running maximum within each key: of the ends' ranks, raised by the key's number
        ends, rank = np.unique(hi, return_inverse=True)
        run = np.repeat(np.arange(len(self.start)), self.end - self.start) * len(ends)
        self.hi = ends[np.maximum.accumulate(rank + run) - run] if len(code) else hi

    def probe(self, refs: pa.RecordBatch) -> np.ndarray:
        """Whether the key of each reference has a parent with lo <= at < hi."""
        h, at, key = refs.column("h").to_numpy(), refs.column("lo").to_numpy(), refs.column("key")
        hit = np.zeros(len(h), bool)
        first = np.searchsorted(self.start_h, h, "left")
        last = np.searchsorted(self.start_h, h, "right")
        step = 0
        while True:  # keys of one hash: nearly always one
            at_run = first + step
            todo = np.flatnonzero((at_run < last) & ~hit)
            if not len(todo):
                return hit
            run = at_run[todo]
            lo, hi = self.start[run].copy(), self.end[run].copy()
            begin = lo.copy()
            same = pc.equal(self.key.take(pa.array(begin)), key.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            when = at[todo]
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                le = self.lo[np.minimum(mid, len(self.lo) - 1)] <= when
                lo = np.where(open_ & le, mid + 1, lo)
                hi = np.where(open_ & ~le, mid, hi)
            before = np.maximum(lo - 1, 0)
            hit[todo] = same & (lo > begin) & (when < self.hi[before])
            step += 1


def _probe_task(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            piece = np.stack([b.column(c).to_numpy() for c in ("zone", "cut", "share", "is_ref")])
            starts = np.flatnonzero(np.r_[True, (piece[:, 1:] != piece[:, :-1]).any(axis=0)])
            for s, e in zip(starts, np.r_[starts[1:], b.num_rows]):  # the runs of a piece's parents or references
                *here, ref = piece[:, s].tolist()
                if here != current:
                    current, parts, index = here, [], None
                rows = b.slice(s, e - s)
                if not ref:
                    parts.append(rows.select(["h", "key", "lo", "hi"]))
                    continue
                if index is None and parts:
                    index, parts = _Parents(parts), []
                hit = index.probe(rows) if index is not None else np.zeros(rows.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in columns], pa.array(hit)], names=[*columns, "hit"])

    return run


def _zone(h: Column, bits: int) -> Column:
    """The first bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _cuts(refs: DataFrame, parents: DataFrame, range_rows: int, split_rows: int) -> tuple[int, DataFrame | None, int]:
    """(bits of a zone, (zone, cuts, shares) of the zones that are split, the most shares)."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    s = Scratch(refs.sparkSession, "zones")
    zone = _zone(F.xxhash64("key"), ZONE_BITS).alias("zone")
    every = refs.select(zone, one.alias("r"), none.alias("p")).unionByName(parents.select(zone, none.alias("r"), one.alias("p")))
    zones, n = s.cut_counting(every.groupBy("zone").agg(F.sum("r").alias("r"), F.sum("p").alias("p")), r=F.sum("r"), p=F.sum("p"))
    bits = min(ZONE_BITS, max(0, (n["r"] + n["p"]) // range_rows).bit_length())
    pieces = lambda c: F.ceil(F.sum(c) / split_rows).cast("int")
    wide = zones.groupBy(F.shiftright("zone", ZONE_BITS - bits).alias("zone")).agg(pieces("r").alias("cuts"), pieces("p").alias("shares")).where("cuts > 1 or shares > 1")
    cuts, n = s.cut_counting(wide, shares=F.max("shares"))
    s.drop(zones)
    return bits, cuts if n["rows"] else None, n["shares"]


def probe(refs: DataFrame, parents: DataFrame, keep: list[str], range_rows: int = RANGE_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """refs (key, at, *keep) as (key, *keep, hit): whether parents (key, lo, hi) has the key with lo <= at < hi.

    Times are bigint; a null lo never holds, a null hi holds for ever, and a null `at` or key is
    never hit. Repeated parents count once, repeated references may. An empty parents table hits
    nothing. Both sides are read twice, the first time for their keys only.
    """
    ps = parents.where("key is not null and lo is not null").select("key", "lo", F.coalesce("hi", F.lit(_FOREVER)).alias("hi"))
    never = F.lit(-(1 << 63))
    rs = refs.select(F.coalesce("key", F.lit("")).alias("key"), F.when(F.col("key").isNotNull(), F.coalesce("at", never)).otherwise(never).alias("lo"), *keep)
    bits, cuts, shares = _cuts(rs, ps, range_rows, split_rows)

    def pieces(df: DataFrame, mine: str, salt: Column, other: str) -> DataFrame:
        """df with its zone and the piece of it: one of `mine`, all of `other`."""
        df = df.withColumn("h", F.xxhash64("key")).withColumn("zone", _zone(F.col("h"), bits))
        if cuts is None:
            return df.withColumn("cut", F.lit(0)).withColumn("share", F.lit(0))
        df = df.join(F.broadcast(cuts), "zone", "left").fillna(1, ["cuts", "shares"])
        names = {"cuts": "cut", "shares": "share"}
        one = F.pmod(salt, F.greatest(mine, F.lit(1))).cast("int")
        return df.withColumn(names[mine], one).withColumn(names[other], F.explode(F.sequence(F.lit(0), F.greatest(other, F.lit(1)) - 1)))

    schema = {f.name: f.dataType for f in rs.schema}
    place = ["zone", "cut", "share"]
    ps = pieces(ps, "shares", F.xxhash64("lo", "hi"), "cuts").select(*place, F.lit(0).alias("is_ref"), "h", "key", "lo", "hi", *[F.lit(None).cast(schema[c]).alias(c) for c in keep])
    rs = pieces(rs, "cuts", F.xxhash64("lo", *keep), "shares").select(*place, F.lit(1).alias("is_ref"), "h", "key", "lo", F.lit(0).cast("bigint").alias("hi"), *keep)
    out = ", ".join(f"`{c}` {schema[c].simpleString()}" for c in ["key", *keep]) + ", hit boolean"
    tried = ps.unionByName(rs).repartition(*place).sortWithinPartitions(*place, "is_ref").mapInArrow(_probe_task(["key", *keep]), out)
    return tried.groupBy("key", *keep).agg(F.bool_or("hit").alias("hit")) if shares > 1 else tried


def _micros(c: str) -> Column:
    """Microseconds of a wall-clock time, whatever the session's time zone."""
    second = f"cast(extract(second from `{c}`) * 1000000 as bigint)"
    return F.expr(f"unix_date(cast(`{c}` as date)) * 86400000000 + (hour(`{c}`) * 60L + minute(`{c}`)) * 60000000L + {second}")


def _always(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("key"), F.lit(-(1 << 63) + 1).cast("bigint").alias("lo"), F.lit(_FOREVER).cast("bigint").alias("hi"))


def edge_orphans(edges: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_field, ref_value, period) of edge ends that no node has at recorded_at.

    A null end is no case; with a null recorded_at only shared nodes count and the period is null.
    """
    end = F.inline(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in ("src", "dst")]))
    refs = edges.select("edge_id", F.date_format("recorded_at", "yyyy-MM").alias("period"), _micros("recorded_at").alias("at"), end)
    refs = refs.where("key is not null").select("key", F.coalesce("at", F.lit(-(1 << 63) + 1)).alias("at"), F.col("edge_id").alias("ref_id"), "ref_field", "period")
    parents = nodes.select(F.col("id").alias("key"), _micros("added_at").alias("lo"), _micros("removed_at").alias("hi"))
    parents = parents.unionByName(_always(shared, F.col("id")))
    missed = probe(refs, parents, ["ref_id", "ref_field", "period"]).where("not hit").select("ref_id", "ref_field", F.col("key").alias("ref_value"), "period").distinct()
    return missed.select(F.lit("edges").alias("ref_table"), "ref_id", "ref_field", "ref_value", "period")


def _repo(c: str) -> Column:
    return F.split_part(F.coalesce(F.col(c), F.lit("")), F.lit("/"), F.lit(1))


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\x01", F.lit(kind), *parts)


def _missing(asked: DataFrame, tries: Column, known: DataFrame) -> DataFrame:
    """The rows of asked of whose keys (an array) none is among known (key), as a table."""
    s = Scratch(asked.sparkSession, "asked")
    asked = s.cut(asked.withColumn("asked", F.monotonically_increasing_id()))
    refs = asked.select("asked", F.explode(tries).alias("key"), F.lit(0).cast("bigint").alias("at"))
    found = probe(refs, _always(known.distinct(), F.col("key")), ["asked"]).where("hit").select("asked")
    return s.cut(asked.join(found, "asked", "left_anti").drop("asked"))


def call_orphans(symbols: DataFrame, shared: DataFrame) -> DataFrame:
    """Calls whose text and base name name no symbol of the file, whose base name no symbol of the
    repository and no shared node. A null call text is no case.

    Base names are sought first, once for each repository; the texts of a file only for those that are left.
    """
    c, b = F.col("ref_value"), F.col("base")
    calls = symbols.where("calls is not null").select(
        F.coalesce("file_path", F.lit("")).alias("file"), F.col("symbol_id").alias("ref_id"), F.date_format("parsed_at", "yyyy-MM").alias("period"), F.explode("calls").alias("ref_value")
    )
    calls = calls.where("ref_value is not null").withColumn("repo", _repo("file")).withColumn("base", base_name(c))
    own = symbols.select(F.coalesce("file_path", F.lit("")).alias("file"), "name", "qualified_name")
    named, qualified = own.where("name is not null"), own.where("qualified_name is not null")

    wide = named.select(_key("repo", _repo("file"), F.col("name")).alias("key")).unionByName(shared.where("name is not null").select(_key("shared", F.col("name")).alias("key")))
    open_ = _missing(calls.select("repo", "base").distinct(), F.array(_key("shared", b), _key("repo", F.col("repo"), b)), wide)
    asked = calls.join(open_, ["repo", "base"], "left_semi").select("file", "ref_value", "base").distinct()
    near = named.select(_key("", F.col("file"), F.col("name")).alias("key")).unionByName(qualified.select(_key("", F.col("file"), F.col("qualified_name")).alias("key")))
    missed = _missing(asked, F.array_distinct(F.array(_key("", F.col("file"), c), _key("", F.col("file"), b))), near).select("file", "ref_value")
    return calls.join(missed, ["file", "ref_value"], "left_semi").select(F.lit("symbols").alias("ref_table"), "ref_id", F.lit("calls").alias("ref_field"), "ref_value", "period").distinct()


def import_orphans(symbols: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """Imports that are no shared import name and match no other file of the repository.

    A text matches a path that contains it (without a leading './'), or whose directory's name
    ends it. The distinct texts of a repository are searched in blocks of its paths' sorted suffixes.
    """
    uses = symbols.where("imports is not null").select(
        F.coalesce("file_path", F.lit("")).alias("file"), F.col("symbol_id").alias("ref_id"), F.date_format("parsed_at", "yyyy-MM").alias("period"), F.explode("imports").alias("ref_value")
    )
    uses = uses.where("ref_value is not null").withColumn("repo", _repo("file"))
    known = shared.where("import_name is not null").select(F.col("import_name").alias("key"))
    left = _missing(uses.select("repo", F.col("ref_value").alias("text")).distinct(), F.array("text"), known)

    there = files.where("rel_path is not null").select(F.col("rel_path").alias("path")).distinct().withColumn("repo", _repo("path"))
    found = imports.matches(left, there, 2)
    found = found.groupBy("repo", "text").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"))

    missed = left.join(found, ["repo", "text"], "left").where("n is null or n = 1").select("repo", F.col("text").alias("ref_value"), "one")
    cases = uses.join(missed, ["repo", "ref_value"]).where("one is null or one = file")
    return cases.select(F.lit("symbols").alias("ref_table"), "ref_id", F.lit("imports").alias("ref_field"), "ref_value", "period").distinct()


def report(orphans: DataFrame) -> DataFrame:
    """Misses per table, field and period."""
    return orphans.groupBy("ref_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("missing"), F.countDistinct("ref_value").alias("missing_values"))
