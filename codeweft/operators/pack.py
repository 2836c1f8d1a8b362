"""Greedy selection of code under a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import Scratch, small
from . import ranking

#: Budget where none is given, what is kept for headings, and the least that must be left then. Fixed values.
BUDGET, RESERVED, LEAST = 3500, 200, 400
#: A score above which a body is packed. Fixed value.
BODY_SCORE = 0.01
#: Candidates that are weighed at once, in rank order. Only ids, scores and costs come to the driver.
CHUNK = 10_000


def usable_budget(budget: int) -> tuple[int, int]:
    """(budget, what of it is usable)."""
    budget = budget if budget > 0 else BUDGET
    left = budget - RESERVED
    return budget, left if left >= LEAST else budget


def _costs(nodes: DataFrame) -> DataFrame:
    """(id, name, skel, full, bare) in estimated tokens; full is null without a body."""
    part = lambda c: F.coalesce(F.col(f"symbol.{c}"), F.lit(""))
    doc, sig, body = part("documentation"), part("signature"), part("body")
    full = F.when(body != "", text.token_estimate(text.full_text(doc, sig, body)))
    return nodes.where("symbol is not null").select(
        "id", F.col("symbol.name").alias("name"), text.token_estimate(text.skeleton(doc, sig)).alias("skel"), full.alias("full"), text.token_estimate(sig).alias("bare")
    )


def _offer(candidates: DataFrame, cost: str, left: int, take) -> int:
    """Offers the candidates (place, id, ...) by descending place, then id, chunk by chunk, to take(row, left), which gives the cost of what it took.

    A chunk holds only what may still fit, and its first row always does, so few chunks are read:
    each costs a token at least, and the budget bounds what is taken.
    """
    rest = candidates
    while True:
        rows = rest.where(F.col(cost) <= left).orderBy(F.desc("place"), F.asc("id")).limit(CHUNK).collect()
        for r in rows:
            left -= take(r, left)
        if len(rows) < CHUNK or left <= 0:
            return left
        last = rows[-1]
        rest = candidates.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("id") > last["id"])))


def select(nodes: DataFrame, edges: DataFrame, ranked: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, int]:
    """Items (pos, id, mode, token_count, relevance, reason) for ranked (id, score), and the tokens used.

    In rank order (score, rounded to 12 places so that no order of summation decides, then id) each
    symbol gets its whole text if it has a body, a score above BODY_SCORE and room, else its
    skeleton if that fits, else it is passed over. Then symbols one outgoing edge away from those,
    in their order, get their bare signatures while there is room. What costs nothing always fits:
    it is not offered on the driver, which would have no bound, but added to the items as a table.
    """
    spark, s = nodes.sparkSession, Scratch(nodes.sparkSession, "pack")
    _, left = usable_budget(budget)
    start, items = left, []
    costs = s.cut(_costs(nodes))

    def primary(r, room):
        body = r["full"] is not None and r["score"] > BODY_SCORE and r["full"] <= room
        cost = r["full"] if body else r["skel"]
        if cost > room:
            return 0
        items.append((r["id"], r["name"], "full" if body else "skeleton", cost, r["score"]))
        return cost

    scored = ranked.select("id", F.round("score", 12).alias("score"))
    candidates = s.cut(costs.join(scored, "id").withColumn("place", F.col("score")))
    whole = F.col("full").isNotNull() & (F.col("score") > BODY_SCORE)  # scores sum to 1, so these are few
    free = (F.col("skel") == 0) & ~whole
    left = _offer(candidates.where(~free), "skel", left, primary)
    chosen = spark.createDataFrame(items, "id string, name string, mode string, token_count int, score double")
    chosen = chosen.unionByName(candidates.where(free).select("id", "name", F.lit("skeleton").alias("mode"), F.lit(0).alias("token_count"), "score"))
    chosen, n = s.cut_counting(chosen)
    why = F.when(F.col("mode") == "full", "Primary target").otherwise("Skeleton reference")
    first = chosen.select(F.lit(0).alias("part"), F.col("score").alias("place"), "id", "mode", "token_count", F.col("score").alias("relevance"), F.format_string("%s (PageRank: %.4f)", why, "score").alias("reason"))

    parts = [first]
    if n["rows"] and left > 0:
        of = chosen.select(F.col("id").alias("src"), "score", "name")
        near = edges.select("src", F.col("dst").alias("id")).distinct().join(small(of, n["rows"]), "src")
        # the chosen that comes first: by score, then id
        near = near.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("at"), "src", "name")).alias("m")).join(small(chosen.select("id"), n["rows"]), "id", "left_anti")
        order, _ = s.cut_counting(near.join(costs, "id").select("id", (-F.col("m.at")).alias("score"), F.col("m.src").alias("src"), F.col("m.name").alias("of"), "bare"))
        taken, end = [], []

        def enrich(r, room):
            if r["bare"] > room or room <= 0:
                return 0
            taken.append((r["id"], r["bare"]))
            if r["bare"] == room:
                end.append(r)
            return r["bare"]

        # places by the chosen's place, then id: few chosen, so their places are ranked on the driver's rows or by ranges
        at = ranking.ranked(chosen.select(F.col("id").alias("src"), "score"), [F.desc("score"), F.asc("src")], "at").select("src", "at")
        near = s.cut(order.join(small(at, n["rows"]), "src").withColumn("place", -F.col("at")))
        left = _offer(near.where("bare > 0"), "bare", left, enrich)
        got = spark.createDataFrame(taken, "id string, token_count int")
        if end:  # nothing is added once the room is used up
            last = end[0]
            near = near.where((F.col("place") > last["place"]) | ((F.col("place") == last["place"]) & (F.col("id") <= last["id"])))
        nothing = near.where("bare = 0").select("id", F.lit(0).alias("token_count"))
        more = near.join(F.broadcast(got), "id").select("id", "token_count").unionByName(nothing).join(near.select("id", "place", "of"), "id")
        parts.append(more.select(F.lit(1).alias("part"), F.col("place").cast("double"), "id", F.lit("skeleton").alias("mode"), "token_count", F.lit(0.0).alias("relevance"), F.concat(F.lit("1-hop dependency of "), "of").alias("reason")))
    every = reduce(DataFrame.unionByName, parts)
    placed = ranking.ranked(every, [F.asc("part"), F.desc("place"), F.asc("id")], "pos")
    return placed.select((F.col("pos") - 1).cast("int").alias("pos"), "id", "mode", "token_count", "relevance", "reason"), start - left


def contents(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """items with file_path, name, kind and content."""
    part = lambda c: F.coalesce(F.col(f"symbol.{c}"), F.lit(""))
    doc, sig, body = part("documentation"), part("signature"), part("body")
    at = nodes.select("id", "file_path", F.col("symbol.name").alias("name"), F.col("symbol.kind").alias("kind"), text.skeleton(doc, sig).alias("skel"), text.full_text(doc, sig, body).alias("full"), sig.alias("bare"))
    content = F.when(F.col("mode") == "full", F.col("full")).when(F.startswith("reason", F.lit("1-hop")), F.col("bare")).otherwise(F.col("skel"))
    return at.join(items, "id").withColumn("content", content).drop("skel", "full", "bare")


def render(items: DataFrame, task: str, budget: int, used: int) -> str:
    """The pack as Markdown: whole texts, then skeletons, each in order. The budget bounds what is collected."""
    rows = items.withColumn("fence", text.fence(F.col("file_path"))).orderBy(F.col("mode") == "skeleton", "pos").collect()
    out = ["# CODE CONTEXT PACK", f"> **Task**: `{task}` | **Budget Used**: {used} / {budget} tokens", ""]
    for mode, title in (("full", "## 🎯 Primary Target Implementations (Full Code)"), ("skeleton", "## 🔗 Direct Dependencies & Skeletons (Signatures Only)")):
        mine = [r for r in rows if r["mode"] == mode]
        if mine:
            out += [title, ""]
        for r in mine:
            head = f"— Symbol: `{r['name']}` ({r['kind']})" if mode == "full" else f"— `{r['name']}` (Signature)"
            out += [f"### File: `{r['file_path']}` {head}", f"```{r['fence']}", r["content"].strip(), "```", ""]
    return "\n".join(out) + "\n"
