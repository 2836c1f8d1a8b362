"""The query tools over an index, and their JSON-RPC frames: a thin facade, all work is in the operators."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import graph, pack, pagerank, search
from .session import Scratch

#: Protocol revision and codes of errors, fixed values.
PROTOCOL, METHOD_ERROR, PARAMS_ERROR = "2024-11-05", -32601, -32602

_TEXT = {"type": "string"}
_NUMBER = {"type": "number"}
#: name -> (description, argument -> type, required arguments)
TOOLS = {
    "get_repo_map": ("Counts of files, symbols and edges, by language and kind.", {"budget_tokens": _NUMBER}, []),
    "get_context_for_task": ("The code most relevant to a task, under a token budget.", {"task_description": _TEXT, "budget_tokens": _NUMBER}, ["task_description"]),
    "get_symbol_callers": ("Who calls a symbol.", {"symbol_name": _TEXT}, ["symbol_name"]),
    "get_symbol_definition": ("Where and how a symbol is defined.", {"symbol_name": _TEXT, "file_path": _TEXT}, ["symbol_name"]),
    "get_impact_analysis": ("What a change of a symbol affects.", {"symbol_name": _TEXT, "max_depth": _NUMBER}, ["symbol_name"]),
    "get_file_outline": ("The symbols of a file.", {"file_path": _TEXT}, ["file_path"]),
}
#: What a risk level means, fixed values.
RISK_NOTES = {"CRITICAL": "Core Architectural Bottleneck", "HIGH": "Heavily Depended On", "MEDIUM": "Moderately Connected", "LOW": "Leaf / Isolated Symbol"}


def _lines(rows: DataFrame, *order: str) -> str:
    """The text of rows (line, ...) in an order: the driver reads one sorted partition after the other."""
    return "\n".join(r[0] for r in rows.orderBy(*order).select("line").toLocalIterator())


class Tools:
    """The six tools over nodes, edges and the symbol rows they came from. Texts are built from sorted results."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, symbols: DataFrame):
        self.nodes, self.edges, self.symbols = nodes, edges, symbols

    def get_repo_map(self, budget_tokens: float | None = None) -> str:
        s = graph.summary(self.nodes, self.edges).first()
        out = ["# Repository Map", "", f"- **Total Indexed Files**: {s.total_files}", f"- **Total Extracted Symbols**: {s.total_symbols}", f"- **Total Dependency Edges**: {s.total_edges}", ""]
        for title, field, unit in (("## Languages", "language", " symbols"), ("## Kinds", "kind", "")):
            rows = graph.histogram(self.nodes, field).orderBy(field).collect()
            out += [title, *[f"- **{r[0]}**: {r[1]}{unit}" for r in rows], ""] if rows else []
        return "\n".join(out)

    def context(self, task: str, budget: int = pack.BUDGET) -> tuple[DataFrame, int, int]:
        """(items with contents, budget, tokens used) for a task."""
        budget, _ = pack.usable_budget(budget)
        ranked = pagerank.pagerank(self.nodes, self.edges, search.seeds(self.nodes, task))
        items, used = pack.select(self.nodes, self.edges, ranked, budget)
        return pack.contents(items, self.nodes), budget, used

    def get_context_for_task(self, task_description: str, budget_tokens: float | None = None) -> str:
        if self.nodes.isEmpty():
            return "The index is empty: index a repository first."
        items, budget, used = self.context(task_description, int(budget_tokens) if budget_tokens and budget_tokens > 0 else pack.BUDGET)
        return pack.render(items, task_description, budget, used)

    def get_symbol_callers(self, symbol_name: str) -> str:
        found = graph.callers(self.nodes, self.edges, symbol_name).withColumn("label", F.substring_index("node_id", "::", -1))
        targets = found.select("node_id", F.format_string("### Symbol `%s` in `%s`", "label", "file_path").alias("line"), F.lit(0).alias("part")).distinct()
        called = F.format_string("- Called by `%s` (Edge: %s)", "caller", "edge_type")
        calls = found.select("node_id", F.coalesce(F.when(F.col("caller").isNotNull(), called), F.lit("- No callers in the index.")).alias("line"), F.lit(1).alias("part"))
        text = _lines(targets.unionByName(calls).unionByName(targets.withColumns({"line": F.lit(""), "part": F.lit(2)})), "node_id", "part", "line")
        return text or f"No symbol named '{symbol_name}' is in the index: not found."

    def _rows(self, hit: DataFrame) -> list:
        """The last symbol row of each node of hit, in order of path and line."""
        names = hit.select("file_path", F.col("symbol.name").alias("name")).distinct()
        last = self.symbols.join(names, ["file_path", "name"], "left_semi").groupBy("file_path", "name").agg(F.max_by(F.struct(*self.symbols.columns), "ordinal").alias("s"))
        return last.select("s.*").orderBy("file_path", "start_line").collect()

    def get_symbol_definition(self, symbol_name: str, file_path: str = "") -> str:
        rows = self._rows(graph.lookup(self.nodes, symbol_name, file_path or ""))
        if not rows:
            return f"Symbol '{symbol_name}' not found in codebase."
        out = []
        for s in rows:
            out += [f"## Symbol: `{s.name}`", f"- **File**: `{s.file_path}` (Lines {s.start_line}-{s.end_line})", f"- **Kind**: {s.kind}", f"- **Language**: {s.language}", f"- **Exported**: {str(bool(s.exported)).lower()}", ""]
            out += ["### Documentation", "```", s.documentation, "```", ""] if s.documentation else []
            out += ["### Signature", f"```{s.language}", s.signature or "", "```", ""]
            out += ["### Implementation", f"```{s.language}", s.body, "```", ""] if s.body else []
            out += ["### Outgoing Calls", *[f"- `{c}`" for c in s.calls], ""] if s.calls else []
            out += ["---"]
        return "\n".join(out)

    def get_impact_analysis(self, symbol_name: str, max_depth: float | None = None) -> str:
        s = Scratch(self.nodes.sparkSession, "analysis")
        depth = int(max_depth) if max_depth and max_depth > 0 else 3
        c = s.cut(graph.impact_callers(self.nodes, self.edges, symbol_name, depth))
        per = s.cut(graph.impact_counts(self.nodes, c, symbol_name))
        note = F.create_map(*[F.lit(x) for kv in RISK_NOTES.items() for x in kv])
        head = F.array(
            F.format_string("## Target: `%s` (defined in `%s`)", F.substring_index("target", "::", -1), "defined_in"), F.lit(""), F.format_string("- **Risk Level**: **%s (%s)**", "risk", note[F.col("risk")]),
            F.format_string("- **Direct Callers**: %d", "direct"), F.format_string("- **Transitive Dependents**: %d", "transitive"), F.format_string("- **Impacted Files**: %d", "files"), F.format_string("- **Impacted Test Suites**: %d", "test_files"), F.lit(""),
        )
        known = c.where("file_path is not null")
        far = F.col("hop") > 1
        place = F.format_string("- `%s` in `%s`", "caller", "file_path")
        callers = known.select("target", F.when(far, 2).otherwise(1).alias("part"), "hop", F.when(far, F.format_string("%s (hop %d)", place, "hop")).otherwise(place).alias("line"))
        tests = known.where(text.is_test_file(F.col("file_path"))).select("target", F.lit(3).alias("part"), F.lit(0).alias("hop"), F.format_string("- `%s`", "file_path").alias("line")).distinct()
        listed = callers.unionByName(tests)
        titles = F.create_map(F.lit(1), F.lit("### Direct callers"), F.lit(2), F.lit("### Transitive dependents"), F.lit(3), F.lit("### Tests to run"))
        titled = listed.select("target", "part").distinct()
        every = per.select("target", F.lit(0).alias("part"), F.posexplode(head).alias("hop", "line")).unionByName(listed)
        every = every.unionByName(titled.select("target", "part", F.lit(-1).alias("hop"), titles[F.col("part")].alias("line"))).unionByName(titled.select("target", "part", F.lit(2**30).alias("hop"), F.lit("").alias("line")))
        told = _lines(every, "target", "part", "hop", "line")
        s.close()
        return f"# Impact of a change of `{symbol_name}`\n\n{told}" if told else f"No symbol named '{symbol_name}' is in the index: not found."

    def get_file_outline(self, file_path: str) -> str:
        there = self.nodes.where(F.endswith("file_path", F.lit(file_path))).agg(F.max("file_path").alias("p")).first().p
        if there is None:
            return f"File '{file_path}' not found in codebase index."
        rows = self._rows(graph.outline(self.nodes, file_path))
        out = [f"# File Outline: `{there}`", "", f"- **Total Symbols Defined**: {len(rows)}", ""]
        if not rows:
            out += ["*No structured symbols extracted for this file.*"]
        for s in rows:
            out += [f"### `{s.name}` ({s.kind})" + (" [Exported]" if s.exported else ""), f"- **Line**: {s.start_line}-{s.end_line}", f"- **Signature**: `{s.signature}`"]
            out += ["- **Calls**: `" + "`, `".join(s.calls) + "`"] if s.calls else []
            out += [""]
        return "\n".join(out)


def catalogue() -> list[dict]:
    """The tools with their JSON schemas."""
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": a, **({"required": r} if r else {})}} for n, (d, a, r) in TOOLS.items()]


def _error(code: int, message: str) -> dict:
    return {"error": {"code": code, "message": message}}


def answer(tools: Tools, frame: dict) -> dict | None:
    """The reply to one frame; None where none is due."""
    method, params = frame.get("method"), frame.get("params")
    base = {"jsonrpc": "2.0", "id": frame.get("id")}
    if method == "notifications/initialized":
        return None
    if method == "initialize":
        return base | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeweft", "version": "1.0.0"}}}
    if method == "tools/list":
        return base | {"result": {"tools": catalogue()}}
    if method != "tools/call":
        return base | _error(METHOD_ERROR, f"Method '{method}' not found")
    if not isinstance(params, dict) or not isinstance(params.get("arguments", {}), dict):
        return base | _error(PARAMS_ERROR, "Invalid parameters")
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return base | _error(METHOD_ERROR, f"Tool '{name}' not recognized")
    _, known, required = TOOLS[name]
    for r in required:
        if not isinstance(given.get(r), str) or not given[r].strip():
            return base | _error(PARAMS_ERROR, f"Missing required parameter '{r}'")
    python = {"string": str, "number": (int, float)}
    args = {k: v for k, v in given.items() if k in known and isinstance(v, python[known[k]["type"]]) and not isinstance(v, bool)}
    return base | {"result": {"content": [{"type": "text", "text": getattr(tools, name)(**args)}]}}


def serve(tools: Tools, lines: Iterable[str]) -> Iterator[str]:
    """Replies to newline-delimited frames; blank and malformed lines are skipped."""
    for line in lines:
        try:
            frame = json.loads(line)
        except ValueError:
            continue
        if isinstance(frame, dict) and (reply := answer(tools, frame)) is not None:
            yield json.dumps(reply, ensure_ascii=False)
