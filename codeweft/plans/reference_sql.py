"""The same queries in SQL, for the oracle."""

from __future__ import annotations

from ..functions import text
from ..parsers import lines as p
from .reference import NAME, OUTLINE, STARTS

_N = """n as (select id, arg_max(struct_pack(t := type, f := file_path, s := symbol), added_at) as m from nodes where removed_at is null and id is not null group by id),
nv as (select id, m.t as type, m.f as file_path, m.s.name as name, m.s.qualified_name as qualified_name, m.s.kind as kind, m.s.language as language, m.s is not null as has_symbol from n
  union all select id, type, file_path, name, name, null, null, name is not null from shared_nodes)"""
_E = """ev as (select src, dst, upper(trim(type)) as type, case when coalesce(weight, 0) = 0 then 1.0 else weight end as weight
  from (select distinct on (edge_id) * from edges where src is not null and dst is not null))"""
_S = "sv as (select distinct on (symbol_id) *, lower(trim(kind)) as k from symbols)"
_F = "fv as (select distinct rel_path as file_path, content from source_files where rel_path is not null)"
_HIT = f"hit as (select id, file_path from nv where has_symbol and (name = '{NAME}' or qualified_name = '{NAME}'))"
_TEST = "(" + " or ".join([f"ends_with(lower({{0}}), '{e}')" for e in text.TEST_ENDINGS] + [f"contains(lower({{0}}), '{x}')" for x in text.TEST_PARTS]) + " or starts_with(regexp_extract(lower({0}), '[^/]*$'), 'test_'))"
_WS = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _estimate(t: str) -> str:
    return f"cast(greatest(len(list_filter(regexp_split_to_array({t}, '{_WS}+'), lambda w: w <> '')), (length({t}) + 3) // 4) as integer)"


def _khop(direction: str, types: str = "") -> str:
    out, into = f"select src as a, dst as b from ev {types}", f"select dst as a, src as b from ev {types}"
    steps = {"out": out, "in": into, "both": f"{out} union {into}"}[direction]
    return f"""with {_N}, {_E}, s as (select distinct id as start from nv where has_symbol and (name = '{STARTS}' or qualified_name = '{STARTS}')),
st as (select distinct a, b from ({steps})), h1 as (select distinct start, b as node_id from s join st on a = start where b <> start),
h2 as (select distinct start, b as node_id from h1 join st on a = h1.node_id where h1.node_id in (select id from nv) and b <> start)
select start, node_id, cast(min(hop) as integer) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) where node_id in (select id from nv) group by all"""


_IMPACT = f"""with {_N}, {_E}, {_HIT}, c as (select distinct src, dst from ev where type in ('CALLS', 'REFERENCES')),
h1 as (select distinct h.id as target, c.src as caller from hit h join c on c.dst = h.id where c.src <> h.id),
h2 as (select distinct h.target, c.src as caller from h1 h join c on c.dst = h.caller where c.src <> h.target),
h3 as (select distinct h.target, c.src as caller from h2 h join c on c.dst = h.caller where c.src <> h.target),
x as (select target, caller, cast(min(hop) as integer) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2 union all select *, 3 from h3) group by all),
imp as (select x.*, nv.file_path from x left join (select distinct id, file_path from nv) nv on nv.id = x.caller)"""


def _rounds(nodes: str, iterations: int) -> list[str]:
    """CTEs of the ranks of nodes from p0 (id, p) on; the last is r{iterations} (id, p, r, d)."""
    parts = [
        f"e as materialized (select src, dst, sum(weight) as w from ev where src in (select id from {nodes}) group by all)",
        "o as (select src, sum(w) as o from e group by src)",
        "r0 as (select id, p, p as r, id not in (select src from o) as d from p0)",
    ]
    for i in range(iterations):
        parts.append(
            f"r{i + 1} as materialized (select r.id, r.p, 0.85 * coalesce(m.m, 0) + 0.85 * r.p * (select coalesce(sum(r), 0) from r{i} where d) + 0.15 * r.p as r, r.d "
            f"from r{i} r left join (select e.dst as id, sum(r.r * e.w / o.o) as m from e join o on o.src = e.src join r{i} r on r.id = e.src group by e.dst) m on m.id = r.id)"
        )
    return parts


def _pagerank(iterations: int, seeded: bool) -> str:
    seed = "case when id in (select id from hit) then 1.0 / (select count(*) from hit) else 0.0 end" if seeded else "1.0 / (select count(*) from nv)"
    parts = [f"with {_N}, {_E}, {_HIT}, p0 as (select id, {seed} as p from nv)", *_rounds("nv", iterations)]
    return ",\n".join(parts) + f"\nselect id, round(r, 9) as score from r{iterations}"


def _tokens(t: str) -> str:
    stops = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    words = f"flatten(list_transform(regexp_extract_all({t}, '[a-zA-Z0-9_]+'), lambda w: list_concat([w], string_split_regex(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_ ]+'))))"
    return f"list_filter(list_transform({words}, lambda w: lower(w)), lambda w: length(w) > 1 and w not in ({stops}))"


_TASK_TOKENS = "'cursorqueue' 'cursor' 'queue' 'snapshot' 'handler' 'schema' 'budget'".split()


def _score() -> str:
    points = " + ".join(f"case when nm = {t} then 10 when contains(nm, {t}) then 4 else 0 end + case when contains(sig, {t}) then 2 else 0 end + case when contains(a, {t}) then 1 else 0 end" for t in _TASK_TOKENS)
    why = ", ".join(f"case when nm = {t} then 'exact_symbol_name' when contains(nm, {t}) then 'partial_symbol_name' end, case when contains(sig, {t}) then 'signature_match' end, case when contains(a, {t}) then 'path_or_doc_match' end" for t in _TASK_TOKENS)
    return f"""x as (select 'sym:' || file_path || '::' || name as id, lower(name) as nm, lower(coalesce(arg_max(coalesce(signature, ''), ordinal), '')) as sig,
  lower(coalesce(arg_max(coalesce(documentation, ''), ordinal), '')) as doc, lower(file_path) as f from sv group by file_path, name),
y as (select id, nm, sig, f || ' ' || nm || ' ' || sig || ' ' || doc as a from x union all select distinct 'file:' || file_path, '', '', lower(file_path) from fv),
z as (select id, cast({points} as double) as score, concat_ws(',', {why}) as reason from y)"""


def _greedy(name: str, of: str, cost: str, left: str) -> str:
    """Steps (n, room) that take from `of` (n, ...) in order what still fits."""
    return f"""{name}(n, room) as (select cast(0 as bigint), cast({left} as integer) union all select c.n, x.room - {cost}
  from (select g.room, min(c.n) as n from {name} g join {of} c on c.n > g.n and g.room > 0 and c.least <= g.room group by g.room) x join {of} c on c.n = x.n)"""


def _pack() -> str:
    doc = "coalesce('/* ' || nullif(d, '') || e' */\\n', '')"
    whole = "case when c.whole is not null and c.score > 0.01 and c.whole <= x.room then c.whole else c.least end"
    return ",\n".join([
        f"with recursive {_S}, {_F}, {_E}, {_score()}", "p0 as (select y.id, coalesce(z.score, 0) / (select sum(score) from z) as p from y left join z on z.id = y.id and z.score > 0)", *_rounds("y", 25),
        "b as (select 'sym:' || file_path || '::' || name as id, name, arg_max(struct_pack(s := coalesce(signature, ''), d := coalesce(documentation, ''), b := coalesce(body, '')), ordinal) as m from sv group by file_path, name)",
        f"""k as (select id, name, {_estimate(f"{doc} || s")} as least, case when b <> '' then {_estimate(f"{doc} || s || e' {{\\n' || b || e'\\n}}'")} end as whole, {_estimate("s")} as bare from (select id, name, m.s as s, m.d as d, m.b as b from b))""",
        "c as materialized (select row_number() over (order by round(r, 12) desc, k.id) as n, k.*, round(r, 12) as score from k join r25 using (id))",
        _greedy("g", "c", whole, "3300"),
        "t as (select c.*, g.room, lag(g.room) over (order by g.n) as before from g left join c using (n))",
        "u as (select *, before - room as cost from t where n > 0)",
        "near as (select ev.dst as id, min(u.n) as first from ev join u on u.id = ev.src group by ev.dst)",
        "h as materialized (select row_number() over (order by first, near.id) as n, near.id, first, k.bare as least from near join k using (id) where near.id not in (select id from u))",
        _greedy("e2", "h", "c.least", "(select min(room) from g)"),
        "v as (select n, id, case when cost = whole and score > 0.01 then 'full' else 'skeleton' end as mode, cost, score from u)",
    ]) + """
select cast(row_number() over (order by part, n) - 1 as integer) as pos, id, mode, cost as token_count, round(score, 9) as relevance, reason from (
  select 0 as part, n, id, mode, cost, score, case mode when 'full' then 'Primary target' else 'Skeleton reference' end || ' (PageRank: ' || printf('%.4f', score) || ')' as reason from v
  union all select 1, h.n, h.id, 'skeleton', h.least, 0.0, '1-hop dependency of ' || u.name from e2 join h using (n) join u on u.n = h.first)"""


_X5 = "case when contains({0}, '.') and not ends_with({0}, '.') then regexp_extract({0}, '[^.]*$') else {0} end"
_CALLS = f"""with {_S}, own as (select file_path, name, qualified_name, ordinal, calls, split_part(file_path, '/', 1) as repo, 'sym:' || file_path || '::' || name as id from sv where file_path is not null and name is not null),
c0 as (select file_path, repo, id as src, trim(unnest(calls)) as c from own), c as (select *, {_X5.format("c")} as b from c0 where c <> ''),
k as (select file_path, key, arg_max(name, ordinal) as name from (select file_path, name as key, name, ordinal from own union all select file_path, qualified_name, name, ordinal from own where qualified_name <> name) group by all),
t as (select c.*, coalesce(w.name, x.name) as hit from c left join k w on w.file_path = c.file_path and w.key = c.c left join k x on x.file_path = c.file_path and x.key = c.b)
select src, 'sym:' || file_path || '::' || hit as dst, 'CALLS' as type, 2.0::double as weight from t where hit is not null
union all select t.src, o.id, 'CALLS', 1.0::double from t join own o on o.repo = t.repo and o.name = t.b where t.hit is null and o.id <> t.src"""
_DELIVERED = """d as (select s, q, max(struct_pack(l := loaded_at, c := lower(checksum), z := size, t := mtime_ns)) as m
  from (select snapshot_no as s, regexp_replace(replace(rel_path, '\\', '/'), '^(\\./|/)+', '') as q, * from file_cache) group by s, q),
w as (select g, s, max(s) over (partition by g order by s rows between unbounded preceding and 1 preceding) as before from (select distinct split_part(q, '/', 1) as g, s from d)),
o as (select w.s, d.q, d.m from d join w on w.g = split_part(d.q, '/', 1) and w.before = d.s),
cl as (select coalesce(a.s, o.s) as snapshot_no, coalesce(a.q, o.q) as rel_path, case when a.q is null then 'deleted' when o.q is null then 'added'
  when (a.m.z = o.m.z and a.m.t = o.m.t) or a.m.c = o.m.c then 'cached' else 'modified' end as status from d a full join o on o.q = a.q and o.s = a.s)"""
_EXT = "lower(regexp_extract({0}, '\\.([^./]*)$', 1))"


def _case(table: dict[str, str], otherwise: str) -> str:
    return f"case {_EXT.format('rel_path')} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else '{otherwise}' end"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINES = f"""li as (select file_path, i as line_no, line, trim(line, e'\\t\\n\\f\\r ' || chr(11)) as t from (select file_path, unnest(string_split_regex(content, '\\r?\\n')) as line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) as i
  from (select distinct file_path, content from fv where content is not null and {_EXT.format('file_path')} in ({{0}}))))"""


def _kept(column: str, dropped: list[str]) -> str:
    return f"array_to_string(list_filter({column}, lambda x: x not in ({', '.join(_q(d) for d in dropped)})), '|')"


_PYTHON = f"""with {_F}, {_LINES.format("'py'")},
r as (select *, case when starts_with(t, '@') then 'held' when regexp_matches(line, {_q(p.PYTHON_CLASS)}) then 'class' when regexp_matches(line, {_q(p.PYTHON_DEF)}) then 'def' end as rule,
  starts_with(line, '    ') or starts_with(line, e'\\t') as inner_ from li where t <> '' and not starts_with(t, '#')),
c as (select *, coalesce(last_value(case when rule = 'class' then regexp_extract(line, {_q(p.PYTHON_CLASS)}, 1) when rule = 'def' and not inner_ then '' end ignore nulls)
    over (partition by file_path order by line_no rows between unbounded preceding and 1 preceding), '') as ctx,
  coalesce(sum(case when rule = 'held' then 0 else 1 end) over (partition by file_path order by line_no rows between unbounded preceding and 1 preceding), 0) as bout from r),
h as (select *, string_agg(case when rule = 'held' then t end, e'\\n') over (partition by file_path, bout order by line_no rows between unbounded preceding and current row) as held from c),
s as (select *, regexp_extract(line, case rule when 'class' then {_q(p.PYTHON_CLASS)} else {_q(p.PYTHON_DEF)} end, 1) as name, rule = 'def' and inner_ and ctx <> '' as method from h where rule in ('class', 'def'))
select file_path, cast(row_number() over (partition by file_path order by line_no) - 1 as integer) as ordinal, name, case when method then ctx || '.' || name else name end as qualified_name,
  case when rule = 'class' then 'class' when method then 'method' else 'function' end as kind, 'python' as language,
  coalesce(held || e'\\n', '') || case when rule = 'class' then t else regexp_replace(t, ':$', '') end as signature, '' as documentation, '' as body, not starts_with(name, '_') as exported,
  cast(line_no as integer) as start_line, cast(line_no as integer) as end_line, {_kept(f"regexp_extract_all(line, {_q(p.PYTHON_CALL)}, 1)", p.PYTHON_NO_CALL)} as calls,
  case when rule = 'class' then array_to_string(list_filter(list_transform(string_split(regexp_extract(line, {_q(p.PYTHON_CLASS)}, 2), ','), lambda x: trim(x)), lambda x: x <> ''), '|') else '' end as implements from s"""
_RUST = f"""with {_F}, {_LINES.format("'rs'")},
r as (select *, case when regexp_matches(line, {_q(p.RUST_IMPL)}) then 'impl' when regexp_matches(line, {_q(p.RUST_STRUCT)}) then 'struct' when regexp_matches(line, {_q(p.RUST_ENUM)}) then 'enum'
  when regexp_matches(line, {_q(p.RUST_TRAIT)}) then 'trait' when regexp_matches(line, {_q(p.RUST_FN)}) then 'fn' end as rule,
  starts_with(line, '    ') or starts_with(line, e'\\t') as inner_ from li where not starts_with(t, '//') and not starts_with(t, '/*')),
c as (select *, coalesce(last_value(case when rule = 'impl' then regexp_extract(line, {_q(p.RUST_IMPL)}, 2) when rule = 'fn' and not inner_ then '' end ignore nulls)
    over (partition by file_path order by line_no rows between unbounded preceding and 1 preceding), '') as ctx from r),
s as (select *, case rule when 'struct' then regexp_extract(line, {_q(p.RUST_STRUCT)}, 1) when 'enum' then regexp_extract(line, {_q(p.RUST_ENUM)}, 1) when 'trait' then regexp_extract(line, {_q(p.RUST_TRAIT)}, 1)
  else regexp_extract(line, {_q(p.RUST_FN)}, 1) end as name, rule = 'fn' and inner_ and ctx <> '' as method from c where rule in ('struct', 'enum', 'trait', 'fn'))
select file_path, cast(row_number() over (partition by file_path order by line_no) - 1 as integer) as ordinal, name, case when method then ctx || '::' || name else name end as qualified_name,
  case when rule = 'struct' then 'struct' when rule = 'enum' then 'type' when rule = 'trait' then 'interface' when method then 'method' else 'function' end as kind, 'rust' as language,
  case when rule = 'fn' and contains(t, '{{') then trim(string_split(t, '{{')[1]) else t end as signature, '' as documentation, '' as body, starts_with(t, 'pub') as exported,
  cast(line_no as integer) as start_line, cast(line_no as integer) as end_line, '' as calls, '' as implements from s"""

_BEFORE = "over (partition by file_path order by line_no rows between unbounded preceding and 1 preceding)"


def _last(event: str, name: str) -> str:
    """The last event before each line, '' at first."""
    return f"coalesce(last_value({event} ignore nulls) {_BEFORE}, '') as {name}"


def _held(rules: str) -> str:
    """CTEs of the annotation lines that wait at each line; lines of the rules do not end the wait."""
    return f"""b as (select *, coalesce(sum(case when rule in ({rules}) then 0 else 1 end) {_BEFORE}, 0) as bout from c),
h as (select *, coalesce(string_agg(case when rule = 'held' then t end, e'\\n') over (partition by file_path, bout order by line_no rows between unbounded preceding and current row) || e'\\n', '') as held from b)"""


def _is(pattern: str, of: str = "t") -> str:
    return f"regexp_matches({of}, {_q(pattern)})"


def _group(pattern: str, n: int, of: str = "t") -> str:
    return f"regexp_extract({of}, {_q(pattern)}, {n})"


def _listed(*lists: str) -> str:
    """The trimmed parts of comma-separated lists, joined."""
    return "array_to_string(list_filter(list_transform(string_split(concat_ws(',', " + ", ".join(lists) + "), ','), lambda x: trim(x)), lambda x: x <> ''), '|')"


def _in(words: list[str]) -> str:
    return ", ".join(_q(w) for w in words)


def _rows(language: str, qualified: str, kind: str, signature: str, exported: str, calls: str, implements: str) -> str:
    return f"""select file_path, cast(row_number() over (partition by file_path order by line_no) - 1 as integer) as ordinal, name, {qualified} as qualified_name, {kind} as kind, '{language}' as language,
  {signature} as signature, '' as documentation, '' as body, {exported} as exported, cast(line_no as integer) as start_line, cast(line_no as integer) as end_line, {calls} as calls, {implements} as implements from s"""


_HEAD = "case when contains(t, '{') then trim(string_split(t, '{')[1]) else t end"
_TS_HEADS = {"arrow": p.TS_ARROW, "function": p.TS_FUNCTION, "class": p.TS_CLASS, "interface": p.TS_INTERFACE, "type": p.TS_TYPE, "enum": p.TS_ENUM}
_TYPESCRIPT = f"""with {_F}, {_LINES.format("'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'")},
r as (select *, case {" ".join(f"when {_is(x)} then '{k}'" for k, x in _TS_HEADS.items())} when not (starts_with(line, ' ') or starts_with(line, e'\\t')) then 'close'
  when (starts_with(line, '  ') or starts_with(line, e'\\t')) and {_is(p.TS_METHOD)} then 'method' end as rule from li where t <> '' and not starts_with(t, '//') and not starts_with(t, '/*')),
c as (select *, {_last(f"case rule when 'class' then {_group(p.TS_CLASS, 1)} when 'close' then '' end", "ctx")} from r),
s as (select * from (select *, case rule {" ".join(f"when '{k}' then {_group(x, 1)}" for k, x in _TS_HEADS.items())} else {_group(p.TS_METHOD, 1)} end as name from c where rule <> 'close')
  where rule <> 'method' or (ctx <> '' and name not in ({_in(p.TS_NO_METHOD)})))
""" + _rows(
    "typescript", "case when rule = 'method' then ctx || '.' || name else name end", "case when rule in ('arrow', 'function') then 'function' when rule = 'enum' then 'type' else rule end",
    f"case when rule = 'arrow' then trim(string_split(t, '=>')[1] || '=>') when rule in ('function', 'method') then {_HEAD} else t end",
    "case when rule = 'method' then not starts_with(name, '_') and not starts_with(name, '#') else starts_with(t, 'export') end",
    f"case when rule in ('arrow', 'function', 'method') then {_kept(f'regexp_extract_all(line, {_q(p._DOTTED_CALL)}, 1)', p.TS_NO_CALL)} else '' end",
    f"case when rule = 'class' then {_listed(_group(p.TS_CLASS, 2), _group(p.TS_CLASS, 3))} else '' end",
)
_JAVA = f"""with {_F}, {_LINES.format("'java'")},
r as (select *, case when {_is(p.JAVA_PACKAGE)} then 'package' when {_is(p.JAVA_IMPORT)} then 'import' when {_is(p.JAVA_ANNOTATION)} then 'held' when {_is(p.JAVA_TYPE)} then 'type'
  when {_is(p.JAVA_CONSTRUCTOR)} or {_is(p.JAVA_METHOD)} then 'member' end as rule from li where t <> '' and not starts_with(t, '//') and not starts_with(t, '/*') and not starts_with(t, '*')),
c as (select *, {_last(f"case when rule = 'type' then {_group(p.JAVA_TYPE, 2)} end", "ctx")}, {_last(f"case when rule = 'package' then {_group(p.JAVA_PACKAGE, 1)} end", "package")} from r),
{_held("'held', 'package', 'import'")},
m as (select *, rule = 'member' and ctx <> '' and (starts_with(line, '  ') or starts_with(line, e'\\t')) and {_group(p.JAVA_CONSTRUCTOR, 1)} = ctx as made from h where rule in ('type', 'member')),
s as (select * from (select *, case when rule = 'type' then {_group(p.JAVA_TYPE, 2)} when made then ctx else {_group(p.JAVA_METHOD, 2)} end as name from m)
  where rule = 'type' or made or ({_is(p.JAVA_METHOD)} and name not in ({_in(p.JAVA_NO_METHOD)}) and {_group(p.JAVA_METHOD, 1)} not in ({_in(p.JAVA_NO_RESULT)})))
""" + _rows(
    "java", "case when rule = 'type' then coalesce(nullif(package, '') || '.', '') || name else coalesce(nullif(ctx, '') || '.', '') || name end",
    f"case when rule = 'type' then {_group(p.JAVA_TYPE, 1)} else 'method' end", f"held || {_HEAD}", "starts_with(t, 'public')",
    _kept(f"regexp_extract_all(line, {_q(p._DOTTED_CALL)}, 1)", p.JAVA_NO_CALL), f"case when rule = 'type' then {_listed(_group(p.JAVA_TYPE, 3), _group(p.JAVA_TYPE, 4))} else '' end",
)
_PHP_LINES = f"""with {_F}, {_LINES.format("'php'")},
r as (select *, case when {_is(p.PHP_NAMESPACE)} then 'namespace' when starts_with(t, '#[') then 'held' when {_is(p.PHP_TYPE)} then 'type' when starts_with(t, 'use ') then 'use' when {_is(p.PHP_FUNCTION)} then 'function' end as rule
  from li where t not in ('', '<?php', '?>') and not starts_with(t, '//') and not starts_with(t, '/*') and not starts_with(t, '*') and not (starts_with(t, '#') and not starts_with(t, '#['))),
c as (select *, {_last(f"case when rule = 'type' then {_group(p.PHP_TYPE, 2)} when rule = 'function' and not (starts_with(line, ' ') or starts_with(line, e'\\t')) then '' end", "ctx")},
  {_last(f"case when rule = 'namespace' then {_group(p.PHP_NAMESPACE, 1)} end", "space")} from r)"""
_PHP = f"""{_PHP_LINES},
{_held("'held', 'namespace', 'use'")},
u as (select file_path, line_no, ctx as name, trim(unnest(string_split({_group(p.PHP_TRAIT_USE, 1)}, ','))) as trait from c where rule = 'use' and ctx <> ''),
tr as (select file_path, name, string_agg(trait, '|' order by line_no, trait) as traits from u where trait <> '' group by all),
s0 as (select *, case when rule = 'type' then {_group(p.PHP_TYPE, 2)} else {_group(p.PHP_FUNCTION, 1)} end as name from h where rule in ('type', 'function')),
s as (select s0.*, rule = 'function' and ctx <> '' and (starts_with(line, '  ') or starts_with(line, e'\\t')) as method,
  case when row_number() over (partition by s0.file_path, s0.name order by s0.line_no) = 1 then traits end as traits from s0 left join tr on tr.file_path = s0.file_path and tr.name = s0.name)
""" + _rows(
    "php", "case when rule = 'type' then coalesce(nullif(space, '') || '\\', '') || name when method then ctx || '::' || name else name end",
    f"case when rule = 'type' then {_group(p.PHP_TYPE, 1)} when method then 'method' else 'function' end", f"held || {_HEAD}", "rule = 'type' or not starts_with(name, '_') or name = '__construct'",
    _kept(f"regexp_extract_all(line, {_q(p.PHP_CALL)}, 1)", p.PHP_NO_CALL),
    f"concat_ws('|', nullif(case when rule = 'type' then {_listed(_group(p.PHP_TYPE, 3), _group(p.PHP_TYPE, 4))} end, ''), traits)",
)
_PHP_IMPORTS = f"""{_PHP_LINES}, i as (select file_path, line_no, {_group(p.PHP_USE, 1)} as imp from c where rule = 'use' and ctx = '')
select file_path, cast(row_number() over (partition by file_path order by line_no) - 1 as integer) as pos, imp from i where imp <> ''"""


def _imports(ext: str, skipped: str, imp: str) -> str:
    return f"""with {_F}, {_LINES.format(ext)}, x as (select file_path, line_no, {imp} as imp from li where not ({skipped}))
select file_path, cast(row_number() over (partition by file_path order by line_no) - 1 as integer) as pos, imp from x where imp <> ''"""


SQL = {
    "graph_summary": f"with {_N}, {_E} select (select count(*) from nv where type = 'file') as total_files, (select count(*) from nv where type <> 'file') as total_symbols, (select count(*) from ev where src in (select id from nv)) as total_edges",
    "language_histogram": f"with {_N} select language, count(*) as symbols from nv where has_symbol group by language",
    "kind_histogram": f"with {_N} select kind, count(*) as symbols from nv where has_symbol group by kind",
    "symbol_lookup": f"with {_N}, {_HIT} select nv.id, nv.file_path, nv.qualified_name from nv join hit using (id)",
    "symbol_callers": f"with {_N}, {_E}, {_HIT} select hit.id as node_id, hit.file_path, e.src as caller, e.type as edge_type from hit left join (select * from ev where type in ('CALLS', 'REFERENCES')) e on e.dst = hit.id",
    "file_outline": f"with {_N} select id, file_path, name, kind from nv where has_symbol and ends_with(file_path, '{OUTLINE}')",
    "khop_out": _khop("out"),
    "khop_in": _khop("in"),
    "khop_both": _khop("both", "where type = 'DEFINES'"),
    "impact_callers": f"{_IMPACT} select * from imp",
    "impact_summary": f"""{_IMPACT}, a as (select target, count(*) as total, count(*) filter (file_path is not null and hop = 1) as direct, count(*) filter (file_path is not null and hop > 1) as transitive,
  count(distinct file_path) as files, count(distinct case when {_TEST.format("file_path")} then file_path end) as test_files from imp group by target)
select hit.id as target, hit.file_path as defined_in, coalesce(total, 0) as total, coalesce(direct, 0) as direct, coalesce(transitive, 0) as transitive, coalesce(files, 0) as files, coalesce(test_files, 0) as test_files,
  case when total > 10 then 'CRITICAL' when total > 4 then 'HIGH' when total > 0 then 'MEDIUM' else 'LOW' end as risk from hit left join a on a.target = hit.id""",
    "remove_test_files": f"with {_N}, {_E}, g as (select id from nv where {_TEST.format('file_path')}) select type, count(*) as edges from ev where src not in (select id from g) and dst not in (select id from g) group by type",
    "pagerank": _pagerank(25, True),
    "pagerank_5": _pagerank(5, True),
    "pagerank_uniform_3": _pagerank(3, False),
    "query_tokens": f"with x as (select doc_id, {_tokens("coalesce(text, '')")} as l from documents) select doc_id, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i), ' ') as tokens from x",
    "token_estimates": f"select doc_id, {_estimate("coalesce(text, '')")} as tokens from documents",
    "built_nodes": f"""with {_S}, {_F} select 'sym:' || file_path || '::' || name as id, 'symbol' as type, file_path, arg_max(struct_pack(x := signature), ordinal).x as signature,
  cast(octet_length(encode(coalesce(arg_max(struct_pack(x := body), ordinal).x, ''))) // 4 as integer) as token_cost, cast(octet_length(encode(coalesce(arg_max(struct_pack(x := signature), ordinal).x, ''))) // 4 as integer) as skel_cost
from sv group by file_path, name union all select distinct 'file:' || file_path, 'file', file_path, null, 0, 0 from fv""",
    "search_scores": f"with {_S}, {_F}, {_score()} select * from z where score > 0",
    "search_ranked": f"with {_S}, {_F}, {_score()} select id, score, row_number() over (order by score desc, id) as rank from z where score > 0",
    "context_pack": _pack(),
    "pagerank_ranked": f"select id, score, row_number() over (order by score desc, id) as rank from ({_pagerank(5, True)})",
    "symbol_definition": f"""with {_S}, l as (select file_path, name, max_by(struct_pack(k := k, l := language, e := exported, s := signature, d := documentation, b := body, a := start_line, z := end_line, c := calls), struct_pack(o := ordinal, i := symbol_id)) as m
  from sv where name = '{NAME}' or qualified_name = '{NAME}' group by file_path, name)
select file_path, name, m.k as kind, m.l as language, m.e as exported, m.s as signature, m.d as documentation, m.b as body, m.a as start_line, m.z as end_line, array_to_string(coalesce(m.c, []), '|') as calls from l""",
    "impact_tests": f"{_IMPACT} select target, file_path as test_file, min(hop) as hop from imp where {_TEST.format('file_path')} group by all",
    "reindex_status": f"""with f as (select distinct on (rel_path) rel_path, octet_length(encode(content)) as z, mtime_ns as t, sha256(content) as c from source_files where rel_path is not null order by rel_path, mtime_ns desc),
x as (select snapshot_no as s, regexp_replace(replace(rel_path, '\\', '/'), '^(\\./|/)+', '') as q, * from file_cache),
d as (select split_part(q, '/', 1) as g, s, q, max_by(struct_pack(c := lower(checksum), z := size, t := mtime_ns), loaded_at) as m from x group by all),
l as (select q, m from d where s = (select max(s) from d e where e.g = d.g)),
k as (select coalesce(f.rel_path, l.q) as rel_path, case when f.rel_path is null then 'deleted' when l.q is null then 'added' when (f.z = l.m.z and f.t = l.m.t) or f.c = l.m.c then 'cached' else 'modified' end as status from f full join l on l.q = f.rel_path)
select rel_path, status, {_EXT.format("rel_path")} in ('go', 'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'py', 'java', 'php', 'rs') as supported from k""",
    "skeletons": f"""with {_S}, x as (select symbol_id, coalesce('/* ' || nullif(documentation, '') || e' */\\n', '') as d, signature, body from sv)
select symbol_id, {_estimate("coalesce(d || signature, '')")} as skel, case when coalesce(body, '') <> '' then {_estimate("coalesce(d || signature || e' {\\n' || body || e'\\n}', '')")} end as full_cost from x""",
    "defines_edges": f"with {_S} select 'file:' || file_path as src, 'sym:' || file_path || '::' || name as dst, 'DEFINES' as type, 1.0::double as weight from sv",
    "import_edges": f"""with {_F}, i as (select file_path, split_part(file_path, '/', 1) as repo, unnest(arg_min(imports, symbol_id)) as imp from symbols where imports is not null group by file_path),
g as (select distinct file_path as path, split_part(file_path, '/', 1) as repo from fv)
select 'file:' || i.file_path as src, 'file:' || g.path as dst, 'IMPORTS' as type, 1.0::double as weight from i join g on g.repo = i.repo and g.path <> i.file_path
where ends_with(path, imp) or contains(path, case when starts_with(imp, './') then substr(imp, 3) else imp end) or ends_with(imp, case when contains(path, '/') then split_part(path, '/', -2) else '.' end)""",
    "call_edges": _CALLS,
    "implements_edges": f"""with {_S}, own as (select *, split_part(file_path, '/', 1) as repo, 'sym:' || file_path || '::' || name as id from sv), a as (select id as src, repo, unnest(implements) as b from own)
select a.src, own.id as dst, 'IMPLEMENTS' as type, 1.5::double as weight from a join own on own.repo = a.repo and own.name = a.b""",
    "incremental_classify": f"with {_DELIVERED} select * from cl",
    "incremental_stats": f"with {_DELIVERED} select count(*) filter (status <> 'deleted') as discovered, count(*) filter (status = 'added') as added, count(*) filter (status = 'modified') as modified, count(*) filter (status = 'deleted') as deleted, count(*) filter (status = 'cached') as cached from cl",
    "watch_bursts": """with e as (select cast(user_id as varchar) as repo_id, event_type as path, ts from events where user_id is not null and event_type is not null and ts is not null),
g as (select *, case when ts - lag(ts) over (partition by repo_id order by ts) <= interval 60 minutes then 0 else 1 end as new from e),
s as (select *, sum(new) over (partition by repo_id order by ts rows unbounded preceding) as n from g)
select repo_id, min(ts) as started_at, max(ts) + interval 60 minutes as ended_at, count(*) as events, array_to_string(list_sort(list(distinct path)), ',') as paths from s group by repo_id, n""",
    "path_rules": f"""select distinct rel_path, size, len(list_filter(string_split(rel_path, '/'), lambda s: (starts_with(s, '.') and s not in ('.', '..')) or lower(s) in ({", ".join(f"'{n}'" for n in text.IGNORED_NAMES)}))) > 0
  or {_EXT.format("rel_path")} in ({", ".join(f"'{n}'" for n in text.BINARY_EXTENSIONS)}) or coalesce(size, 0) > {text.MAX_FILE_KB * 1024} as ignored,
  {_case(text.LANGUAGES, "unknown")} as language, {_case(text.FENCES, "")} as fence, {_TEST.format("rel_path")} as is_test, case when contains(rel_path, '/') then split_part(rel_path, '/', -2) else '.' end as directory
from source_files where rel_path is not null""",
    "checksums": "select distinct rel_path, sha256(content) as checksum from source_files",
    "symbol_locations": f"with {_S} select symbol_id, file_path || ':' || start_line || ':' || start_col || '-' || end_line || ':' || end_col as location, start_line > 0 and end_line >= start_line as valid from sv",
    "parse_python": _PYTHON,
    "parse_rust": _RUST,
    "parse_typescript": _TYPESCRIPT,
    "parse_java": _JAVA,
    "parse_php": _PHP,
    "imports_php": _PHP_IMPORTS,
    "imports_python": _imports("'py'", "t = '' or starts_with(t, '#') or starts_with(t, '@')", f"regexp_extract(line, {_q(p.PYTHON_IMPORT)}, 1) || regexp_extract(line, {_q(p.PYTHON_IMPORT)}, 2)"),
    "imports_typescript": _imports("'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'", "t = '' or starts_with(t, '//') or starts_with(t, '/*')", f"regexp_extract(line, {_q(p.TS_IMPORT)}, 1) || regexp_extract(line, {_q(p.TS_IMPORT)}, 2)"),
    "imports_java": _imports("'java'", f"t = '' or starts_with(t, '//') or starts_with(t, '/*') or starts_with(t, '*') or regexp_matches(t, {_q(p.JAVA_PACKAGE)})", f"regexp_extract(t, {_q(p.JAVA_IMPORT)}, 1)"),
    "imports_rust": _imports("'rs'", "starts_with(t, '//') or starts_with(t, '/*')", f"trim(regexp_extract(line, {_q(p.RUST_USE)}, 1))"),
}
