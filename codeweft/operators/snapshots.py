"""Changes between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import BROADCAST_ROWS, Scratch

#: Rows of one (group, snapshot) from which its neighbours are looked up in several pieces. At most about LARGE deliveries hold so many, whatever the table.
PIECE_ROWS, LARGE = 50_000, 4096


def canonical_path(c: Column) -> Column:
    """Slashes for backslashes, without leading './' and doubled or leading slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.translate(c, "\\", "/")), "/(\\.?/)+", "/"), "^(\\./|/)+", "")


def deliveries(rows: DataFrame) -> tuple[DataFrame, int]:
    """(grp, snapshot_no, prev_no, next_no, pieces) of a table (grp, snapshot_no), and how many there are.

    A group's neighbours are its own deliveries: a snapshot that it lacks is passed over, after its last there is none.
    `pieces` follows from a delivery's rows: one, unless it holds more than PIECE_ROWS and a LARGE-th part of the table.
    """
    order = Window.partitionBy("grp").orderBy("snapshot_no")
    per = rows.where("grp is not null and snapshot_no is not null").groupBy("grp", "snapshot_no").agg(F.count(F.lit(1)).alias("n"))
    near = per.select("grp", "snapshot_no", "n", F.lag("snapshot_no").over(order).alias("prev_no"), F.lead("snapshot_no").over(order).alias("next_no"))
    table, seen = Scratch(rows.sparkSession, "deliveries").cut_counting(near, total=F.sum("n"))
    piece = max(PIECE_ROWS, seen["total"] // LARGE)
    return table.withColumn("pieces", F.ceil(F.col("n") / piece).cast("int")).drop("n"), seen["rows"]


def placed(rows: DataFrame, key: str, delivered: tuple[DataFrame, int]) -> DataFrame:
    """rows (grp, snapshot_no, key, ...) with prev_no and next_no.

    Many deliveries are joined by a shuffle, by hint: Spark sees the size of the written file, a tenth of what the driver
    would hold. One may hold a third of the rows, so those of several pieces, which are few, are broadcast to salt their rows.
    """
    table, n = delivered
    at = ["grp", "snapshot_no"]
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop("pieces")), at)
    large = table.where("pieces > 1").select(*at, "pieces")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    salt = F.pmod(F.xxhash64(key), F.coalesce("pieces", F.lit(1))).cast("int")
    return rows.join(F.broadcast(large), at, "left").withColumn("salt", salt).drop("pieces").join(spread.hint("merge"), [*at, "salt"]).drop("salt")


def snapshot_changes(rows: DataFrame, loaded_at: str, hashed: list[Column]) -> DataFrame:
    """Rows (grp, snapshot_no, key, change) of a table (grp, snapshot_no, key, loaded_at, ...).

    A key that recurs in a snapshot counts as loaded last (equal times: the larger row hash). A group's snapshot is
    compared with that group's previous delivered one; its first gives no rows, nor does one it
    lacks. Rows without group, snapshot number or key are left out. `hashed` are the canonical
    columns whose hash tells a change; null equals null.

    Each row meets the key's rows before and after it, and is looked up among the deliveries only where a change
    may follow: not where it stands unchanged between numbers one less and one more, which leave no room for a delivery.
    """
    row_hash = F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in hashed])
    keyed = rows.where(F.col("grp").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("key").isNotNull())
    last = keyed.groupBy("grp", "snapshot_no", "key").agg(F.max(F.struct(F.col(loaded_at).alias("t"), row_hash.alias("h"))).alias("m"))
    order = Window.partitionBy("grp", "key").orderBy("snapshot_no")
    seen = last.select("grp", "snapshot_no", "key", F.col("m.h").alias("h")).select(
        "*", F.lag("snapshot_no").over(order).alias("was"), F.lag("h").over(order).alias("old_h"), F.lead("snapshot_no").over(order).alias("then")
    )
    if dict(rows.dtypes)["snapshot_no"] in ("tinyint", "smallint", "int", "bigint"):
        plain = (F.try_subtract("snapshot_no", "was") == 1) & (F.try_subtract("then", "snapshot_no") == 1) & (F.col("h") == F.col("old_h"))
        seen = seen.where(~F.coalesce(plain, F.lit(False)))
    known = placed(seen, "key", deliveries(keyed))

    in_prev, in_next = (F.coalesce(F.col(a) == F.col(b), F.lit(False)) for a, b in (("was", "prev_no"), ("then", "next_no")))
    here = F.when(F.col("prev_no").isNull(), None).when(~in_prev, "added").when(F.col("h") != F.col("old_h"), "modified")
    gone = F.when(F.col("next_no").isNotNull() & ~in_next, "removed")
    each = F.array(F.struct("snapshot_no", here.alias("change")), F.struct(F.col("next_no").alias("snapshot_no"), gone.alias("change")))
    changes = known.select("grp", "key", F.inline(F.filter(each, lambda x: x["change"].isNotNull())))
    return changes.select("grp", "snapshot_no", "key", "change")


def file_changes(cache: DataFrame) -> DataFrame:
    """snapshot_changes of file deliveries (snapshot_no, rel_path, checksum, loaded_at): keyed by
    canonical path within its repository (the first segment), changed if the checksum differs
    other than in letter case."""
    path = canonical_path(F.col("rel_path"))
    rows = cache.select(
        F.split_part(path, F.lit("/"), F.lit(1)).alias("grp"),
        "snapshot_no",
        path.alias("key"),
        F.lower(F.trim("checksum")).alias("sum"),
        "loaded_at",
    )
    return snapshot_changes(rows, "loaded_at", [F.col("sum")])
