"""Lexical search over nodes, in column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Points of a token: the symbol's whole name, part of it, in the signature, anywhere. Fixed values.
WHOLE, PART, SIGNATURE, ANYWHERE = 10.0, 4.0, 2.0, 1.0


def score(nodes: DataFrame, query: str) -> DataFrame:
    """(id, score, reason) of the nodes with a score above 0 for the query's tokens; files earn only the last point.

    A query without tokens matches nothing. Nulls count as ''.
    """
    fields = {f.name for f in nodes.schema["symbol"].dataType.fields}
    part = lambda c: F.lower(F.coalesce(F.col(f"symbol.{c}"), F.lit(""))) if c in fields else F.lit("")
    low = F.lower(F.coalesce("file_path", F.lit("")))
    all_text = F.when(F.col("symbol").isNotNull(), F.concat_ws(" ", low, part("name"), part("signature"), part("documentation"))).otherwise(low)
    seen = nodes.select("id", part("name").alias("name"), part("signature").alias("sig"), all_text.alias("all"), text.tokenize_query(F.lit(query)).alias("tokens"))

    def points(t):
        name = F.when(F.col("name") == t, WHOLE).when(F.contains("name", t), PART).otherwise(0.0)
        return name + F.when(F.contains("sig", t), SIGNATURE).otherwise(0.0) + F.when(F.contains("all", t), ANYWHERE).otherwise(0.0)

    def reasons(t):
        name = F.when(F.col("name") == t, "exact_symbol_name").when(F.contains("name", t), "partial_symbol_name")
        return F.array(name, F.when(F.contains("sig", t), "signature_match"), F.when(F.contains("all", t), "path_or_doc_match"))

    total = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + points(t))
    why = F.array_join(F.flatten(F.transform("tokens", reasons)), ",")
    return seen.select("id", total.alias("score"), why.alias("reason")).where("score > 0")


def seeds(nodes: DataFrame, query: str) -> DataFrame:
    """The matches of a query as seeds (id, weight)."""
    return score(nodes, query).select("id", F.col("score").alias("weight"))
