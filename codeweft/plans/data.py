"""Queries on the numbered data problems of general kind, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, hotkeys, orphans, snapshots
from ..session import Scratch, load


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes, shared, symbols, files = (load(spark, sf_dir, t) for t in ("edges", "nodes", "shared_nodes", "symbols", "source_files"))
    return (
        orphans.edge_orphans(edges, nodes, shared)
        .unionByName(orphans.call_orphans(symbols, shared))
        .unionByName(orphans.import_orphans(symbols, files, shared))
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(p3_found(spark, sf_dir))


def extends_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "edges").where("lower(trim(type)) = 'extends'")
    return edges.select(F.col("src").alias("child"), F.col("dst").alias("parent"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(extends_links(spark, sf_dir)).select("node_id", "root_id", "depth")


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found with the number of descendants and the full path ('>' between ids; null under cycles)."""
    found = hierarchy.hierarchy_with_paths(extends_links(spark, sf_dir))
    return found.select("node_id", "root_id", "depth", "descendants", F.array_join("path", ">").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(extends_links(spark, sf_dir))


def _totals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "symbols.name": hotkeys.key_totals(load(spark, sf_dir, "symbols"), "name").withColumn("weight", F.lit(None).cast("double")),
        "edges.dst": hotkeys.key_totals(load(spark, sf_dir, "edges"), "dst", {"weight": F.col("weight")}),
    }


def p5_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [t.select(F.lit(f).alias("key_field"), F.col("key").alias("key_value"), "n", F.round("weight", 6).alias("weight")) for f, t in _totals(spark, sf_dir).items()]
    return each[0].unionByName(each[1]).where("key_value is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "totals")
    hot = [hotkeys.hot_keys(s.cut(t)).select(F.lit(f).alias("key_field"), F.col("key").alias("key_value")) for f, t in _totals(spark, sf_dir).items()]
    return hot[0].unionByName(hot[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshots.file_changes(load(spark, sf_dir, "file_cache"))
    return changes.select("snapshot_no", F.col("key").alias("rel_path"), "change")


def p6_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived counts of each delivery that has a predecessor, beside the indexer's own counters."""
    changes = snapshots.file_changes(load(spark, sf_dir, "file_cache"))
    kinds = {"added": "added", "modified": "modified", "removed": "deleted"}
    mine = changes.groupBy(F.col("grp").alias("repo_id"), "snapshot_no").agg(*[F.count_if(F.col("change") == k).alias(f"{v}_found") for k, v in kinds.items()])
    told = load(spark, sf_dir, "index_runs").groupBy("repo_id", "snapshot_no").agg(*[F.max(v).cast("bigint").alias(f"{v}_told") for v in kinds.values()])
    return mine.join(told, ["repo_id", "snapshot_no"], "left")


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_hierarchy, p4_descendants, p5_key_totals, p5_found, p6_found, p6_counters)}

_LINKS = """x as (select distinct src as child, dst as parent from edges where lower(trim(type)) = 'extends' and src is not null and dst is not null),
tree as (select child, min(parent) as parent from x group by child),
ids as (select child as id from tree union select parent from tree)"""
_P4 = f"""with recursive {_LINKS},
up(node_id, anc) as (select child, parent from tree union select u.node_id, t.parent from up u join tree t on t.child = u.anc),
ring as (select node_id as id from up where node_id = anc),
ends as (select i.id as node_id, count(u.anc) as k, min(case when r.id is not null then u.anc end) as ring_id,
  min(case when t.child is null then u.anc end) as top
  from ids i left join up u on u.node_id = i.id left join ring r on r.id = u.anc left join tree t on t.child = u.anc group by i.id)
select node_id, coalesce(ring_id, top, node_id) as root_id, cast(case when ring_id is not null then -1 else k end as bigint) as depth from ends"""
_PATHS = f"""with recursive {_LINKS},
down(node_id, path, depth) as (select id, id, cast(0 as bigint) from ids where id not in (select child from tree)
  union all select t.child, d.path || '>' || t.child, d.depth + 1 from down d join tree t on t.parent = d.node_id)"""
_P3_EDGES = """select distinct 'edges' as ref_table, r.edge_id as ref_id, r.f as ref_field, r.v as ref_value, strftime(r.recorded_at, '%Y-%m') as period
from (select edge_id, 'src' as f, src as v, recorded_at from edges union all select edge_id, 'dst', dst, recorded_at from edges) r
where r.v is not null and r.v not in (select id from shared_nodes) and not exists (select 1 from nodes n where n.id = r.v
  and n.added_at <= r.recorded_at and (n.removed_at is null or r.recorded_at < n.removed_at))"""
_P3_CALLS = """select distinct 'symbols' as ref_table, c.symbol_id as ref_id, 'calls' as ref_field, c.c as ref_value, strftime(c.parsed_at, '%Y-%m') as period
from (select symbol_id, file_path, split_part(file_path, '/', 1) as repo, parsed_at, c,
    case when contains(trim(c), '.') and not ends_with(trim(c), '.') then regexp_extract(trim(c), '[^.]*$') else trim(c) end as b
  from (select symbol_id, file_path, parsed_at, unnest(calls) as c from symbols) where c is not null) c
where not exists (select 1 from symbols s where s.file_path = c.file_path and (s.name in (c.c, c.b) or s.qualified_name in (c.c, c.b)))
  and not exists (select 1 from symbols s where split_part(s.file_path, '/', 1) = c.repo and s.name = c.b)
  and not exists (select 1 from shared_nodes n where n.name = c.b)"""
_P3_IMPORTS = """select distinct 'symbols' as ref_table, i.symbol_id as ref_id, 'imports' as ref_field, i.i as ref_value, strftime(i.parsed_at, '%Y-%m') as period
from (select symbol_id, file_path, split_part(file_path, '/', 1) as repo, parsed_at, unnest(imports) as i from symbols) i
where i.i is not null and not exists (select 1 from shared_nodes n where n.import_name = i.i)
  and not exists (select 1 from source_files f where split_part(f.rel_path, '/', 1) = i.repo and f.rel_path <> i.file_path
    and (ends_with(f.rel_path, i.i) or contains(f.rel_path, case when starts_with(i.i, './') then substr(i.i, 3) else i.i end)
      or ends_with(i.i, case when contains(f.rel_path, '/') then split_part(f.rel_path, '/', -2) else '.' end)))"""
_P3 = f"{_P3_EDGES} union {_P3_CALLS} union {_P3_IMPORTS}"
_P6 = """with c as (select regexp_replace(replace(rel_path, '\\', '/'), '^(\\./|/)+', '') as p, snapshot_no as s, lower(checksum) as k, loaded_at as t from file_cache),
l as (select split_part(p, '/', 1) as g, s, p, max_by(k, t) as k from c group by all),
d as (select g, s, lag(s) over (partition by g order by s) as prev from (select distinct g, s from l)),
n as (select l.*, d.prev from l join d using (g, s) where prev is not null),
o as (select l.g, d.s, l.p, l.k from l join d on d.g = l.g and d.prev = l.s),
x as (select coalesce(n.g, o.g) as g, coalesce(n.s, o.s) as s, coalesce(n.p, o.p) as p,
  case when o.p is null then 'added' when n.p is null then 'removed' when n.k is distinct from o.k then 'modified' end as change
  from n full join o on n.g = o.g and n.s = o.s and n.p = o.p)"""

SQL = {
    "p3_found": _P3,
    "p3_report": f"select ref_table, ref_field, period, count(*) as missing, count(distinct ref_value) as missing_values from ({_P3}) group by all",
    "p4_found": _P4,
    "p4_hierarchy": f"""select f.node_id, f.root_id, f.depth, case when f.depth >= 0 then (select count(*) from ({_PATHS} select * from down) z
  where z.path like '%' || f.node_id || '>%') end as descendants, d.path from ({_P4}) f left join ({_PATHS} select node_id, path from down) d on d.node_id = f.node_id""",
    "p4_descendants": f"""with recursive {_LINKS},
rooted(node_id) as (select id from ids where id not in (select child from tree) union select t.child from rooted r join tree t on t.parent = r.node_id),
up(node_id, descendant_id, distance) as (select t.parent, t.child, cast(1 as bigint) from tree t join rooted r on r.node_id = t.child
  union all select t.parent, u.descendant_id, u.distance + 1 from up u join tree t on t.child = u.node_id)
select node_id, descendant_id, distance from up""",
    "p5_key_totals": """select 'symbols.name' as key_field, name as key_value, count(*) as n, cast(null as double) as weight from symbols where name is not null group by name
union all select 'edges.dst', dst, count(*), round(sum(coalesce(weight, 0)), 6) from edges where dst is not null group by dst""",
    "p5_found": """select 'symbols.name' as key_field, name as key_value from symbols where name is not null group by name
having count(*) >= 0.02 * (select count(*) from symbols)
union all select 'edges.dst', dst from edges where dst is not null group by dst having count(*) >= 0.02 * (select count(*) from edges)""",
    "p6_found": f"{_P6} select s as snapshot_no, p as rel_path, change from x where change is not null",
    "p6_counters": f"""{_P6}, m as (select g as repo_id, s as snapshot_no, count(*) filter (change = 'added') as added_found,
  count(*) filter (change = 'modified') as modified_found, count(*) filter (change = 'removed') as deleted_found from x where change is not null group by all)
select m.*, cast(t.added_told as bigint) as added_told, cast(t.modified_told as bigint) as modified_told, cast(t.deleted_told as bigint) as deleted_told
from m left join (select repo_id, snapshot_no, max(added) as added_told, max(modified) as modified_told, max(deleted) as deleted_told
  from index_runs group by all) t using (repo_id, snapshot_no)""",
}
