"""Queries p2 to p6: records that refer, change, nest and form trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import feed, hierarchy, nested, references, snapshots
from factloom.plans.tables import table
from factloom.session import scratch_path


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbols, entities = table(spark, d, "symbols"), table(spark, d, "entities")
    of = lambda df, name, ref: df.select(F.lit(name).alias("ref_table"), "project_id", F.col(ref).alias("ref"), "recorded_at", "row_id", "generation")
    return of(symbols, "symbols", "alias_target").unionByName(of(entities, "entities", "symbol")), symbols


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    refs, symbols = _references(spark, d)
    return references.orphan_rows(refs.drop("generation"), symbols).select("ref_table", "row_id").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    refs, symbols = _references(spark, d)
    return references.orphan_counts(references.orphan_rows(refs, symbols), refs)


def _current_files(spark: SparkSession, d: str) -> DataFrame:
    """The feed applied in two slices, so that the second meets a base; the cut is the middle of change_id.

    Changes without a change_id arrive last, so they are in the second slice.
    """
    updates = table(spark, d, "updates")
    low, high, n = updates.agg(F.min("change_id"), F.max("change_id"), F.count(F.lit(1))).first()
    store = feed.BucketedTable(spark, scratch_path(spark, "files"), feed.buckets_for(n))
    if low is None:
        store.apply(updates)
        return store.current()
    middle = (low + high) // 2
    store.apply(updates.where(F.col("change_id") <= middle))
    store.apply(updates.where((F.col("change_id") > middle) | F.col("change_id").isNull()))
    return store.current()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _current_files(spark, d).select("project_id", "path", "version")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return _current_files(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "sources"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p4_found(spark, d))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(table(spark, d, "findings"), table(spark, d, "file_facts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridges(_occurrences(spark, d)).select("child", "record_id", "pos_1", "pos_2")


def p5_bridges(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridges(_occurrences(spark, d))


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_occurrences(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    current = hierarchy.current_symbols(table(spark, d, "symbols"))
    endless = hierarchy.endless_nodes(hierarchy.alias_edges(current))
    return current.join(endless, "node", "left_semi").select("project_id", F.col("id").alias("symbol_id"))


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    current = hierarchy.current_symbols(table(spark, d, "symbols"))
    return current, hierarchy.hierarchy(current, hierarchy.alias_edges(current))


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and path as node numbers (row_id of the current row) of every current symbol."""
    current, tree = _tree(spark, d)
    return current.select("project_id", F.col("id").alias("symbol_id"), "node").join(tree, "node").select(
        "project_id", "symbol_id", "node", "root", "depth", "endless", F.array_join(F.when(~F.col("endless"), F.col("path")), "/").alias("path")
    )


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, d)[1])


_PLAIN = """nullif(nullif(case when starts_with(translate({0}, chr(92), '/'), '/') then '/' else '' end
  || array_to_string(list_filter(string_split(translate({0}, chr(92), '/'), '/'), lambda x: x not in ('', '.')), '/'), ''), '/')"""

_ORPHANS = """with refs as (
  select 'symbols' ref_table, coalesce(project_id, chr(0)) project_id, alias_target as ref, recorded_at, row_id, generation from symbols
  union all select 'entities', coalesce(project_id, chr(0)), symbol, recorded_at, row_id, generation from entities),
r as (select distinct * from refs where ref is not null and ref <> ''),
s as (select coalesce(project_id, chr(0)) project_id, id, recorded_at, arg_max(coalesce(deleted_at, timestamp '9999-12-31'), row_id) deleted_at from symbols group by 1, 2, 3),
live as (select r.*, s.recorded_at found_at, s.deleted_at from r asof left join s
  on r.project_id = s.project_id and r.ref = s.id and r.recorded_at >= s.recorded_at),
orphans as (select * from live where found_at is null or deleted_at <= recorded_at)
"""

_CURRENT = """s as (select project_id, id, row_id, alias_target, deleted_at, row_number() over (partition by project_id, id order by recorded_at desc, row_id desc) k from symbols),
c as (select project_id, id, row_id, alias_target from s where k = 1 and deleted_at is null),
e as (select a.project_id, a.id, a.row_id, b.row_id parent from c a left join c b on a.project_id = b.project_id and a.alias_target = b.id and a.alias_target <> '')"""

_SNAPSHOT = f"""with r as (select project_id, generation, {_PLAIN.format("path")} path, regexp_replace(lower(trim(sha256)), '^sha256:', '') digest, delivered_at from sources),
s as (select project_id, generation, path, arg_max(coalesce(digest, '?'), delivered_at) digest from r where generation >= 1 and path is not null group by 1, 2, 3),
g as (select project_id, generation, lead(generation) over (partition by project_id order by generation) nxt, lag(generation) over (partition by project_id order by generation) prv
  from (select distinct project_id, generation from s)),
n as (select s.*, g.prv from s join g using (project_id, generation) where g.prv is not null),
o as (select s.project_id, g.nxt generation, s.path, s.digest from s join g using (project_id, generation) where g.nxt is not null),
ch as (select coalesce(n.project_id, o.project_id) project_id, coalesce(n.generation, o.generation) generation, coalesce(n.path, o.path) path,
  case when o.path is null then 'added' when n.path is null then 'removed' when n.digest <> o.digest and n.digest <> '?' and o.digest <> '?' then 'changed' end change_kind
  from n full join o on n.project_id = o.project_id and n.generation = o.generation and n.path = o.path)
"""

_FEED = f"""with r as (select change_id, project_id, {_PLAIN.format("path")} path, version, coalesce(deleted, false) deleted, coalesce(source, '') source from updates),
k as (select *, row_number() over (partition by project_id, path order by version desc, change_id) n from r where version is not null and path is not null)
"""

_NESTED = """with f as (select distinct on (record_id) record_id, evidence, fixes from findings),
p as (select distinct on (record_id) record_id, try_cast(payload as json) j from file_facts where payload is not null),
q as (select record_id, j from p where json_type(j) = 'OBJECT'),
calls as (select record_id, unnest(range(len(a))) i, unnest(a) e from
  (select record_id, case json_type(j, '$.calls') when 'ARRAY' then cast(j->'$.calls' as json[]) when 'OBJECT' then [j->'$.calls'] else [] end a from q)),
asyncs as (select record_id, unnest(range(len(a))) i, unnest(a) e from
  (select record_id, case json_type(j, '$.asyncFunctions') when 'ARRAY' then cast(j->'$.asyncFunctions' as json[]) when 'OBJECT' then [j->'$.asyncFunctions'] else [] end a from q)),
args as (select record_id, i, unnest(range(len(a))) k, unnest(a) e from
  (select record_id, i, case json_type(e, '$.arguments') when 'ARRAY' then cast(e->'$.arguments' as json[]) when 'OBJECT' then [e->'$.arguments'] else [] end a from calls where json_type(e) = 'OBJECT')),
awaits as (select record_id, i, unnest(range(len(a))) k, unnest(a) e from
  (select record_id, i, case json_type(e, '$.callsAfterAwait') when 'ARRAY' then cast(e->'$.callsAfterAwait' as json[]) when 'OBJECT' then [e->'$.callsAfterAwait'] else [] end a from asyncs where json_type(e) = 'OBJECT')),
ev as (select record_id, unnest(range(len(evidence))) i, unnest(evidence) e from f),
fx as (select record_id, unnest(range(len(fixes))) i, unnest(fixes) e from f),
ed as (select record_id, i, unnest(range(len(e.edits))) k, unnest(e.edits) x from fx where e is not null),
seen as (select 'evidence' child, record_id, i pos_1, -1 pos_2 from ev where e is not null
  union all select 'fix', record_id, i, -1 from fx where e is not null
  union all select 'edit', record_id, i, k from ed where x is not null
  union all select 'call', record_id, i, -1 from calls where json_type(e) = 'OBJECT'
  union all select 'call_argument', record_id, i, k from args where json_type(e) = 'OBJECT'
  union all select 'async_function', record_id, i, -1 from asyncs where json_type(e) = 'OBJECT'
  union all select 'call_after_await', record_id, i, k from awaits where json_type(e) = 'OBJECT')
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_files, p4_found, p4_counts, p5_found, p5_bridges, p5_objects, p6_found, p6_hierarchy, p6_descendants)}

SQL = {
    "p2_found": _ORPHANS + "select distinct ref_table, row_id from orphans",
    "p2_counts": _ORPHANS
    + """select a.ref_table, a.generation, a.n as n_references, coalesce(b.n, 0) as n_orphans, round(coalesce(b.n, 0) / a.n, 6) as orphan_rate
from (select ref_table, generation, count(distinct row_id) n from r group by 1, 2) a
left join (select ref_table, generation, count(distinct row_id) n from orphans group by 1, 2) b
on a.ref_table = b.ref_table and a.generation is not distinct from b.generation""",
    "p3_found": _FEED + "select project_id, path, version from k where n = 1 and not deleted",
    "p3_files": _FEED + "select project_id, path, version, source from k where n = 1 and not deleted",
    "p4_found": _SNAPSHOT + "select * from ch where change_kind is not null",
    "p4_counts": _SNAPSHOT
    + """select project_id, generation, count(*) filter (change_kind = 'added') as n_added, count(*) filter (change_kind = 'removed') as n_removed,
count(*) filter (change_kind = 'changed') as n_changed from ch where change_kind is not null group by 1, 2""",
    "p5_found": _NESTED + "select child, record_id, pos_1::int as pos_1, pos_2::int as pos_2 from seen",
    "p6_found": "with recursive "
    + _CURRENT
    + """, ends as (select row_id from e where parent is null union select e.row_id from e join ends on e.parent = ends.row_id)
select project_id, id as symbol_id from e where row_id not in (select row_id from ends)""",
    "p6_hierarchy": "with recursive "
    + _CURRENT
    + """, t as (select row_id, row_id as root, 0::bigint as depth, row_id::varchar as path from e where parent is null
union all select e.row_id, t.root, t.depth + 1, e.row_id || '/' || t.path from e join t on e.parent = t.row_id)
select e.project_id, e.id as symbol_id, e.row_id as node, t.root, t.depth, t.root is null as endless, t.path from e left join t using (row_id)""",
    "p6_descendants": "with recursive "
    + _CURRENT
    + """, t as (select row_id, [row_id] as path from e where parent is null
union all select e.row_id, list_prepend(e.row_id, t.path) from e join t on e.parent = t.row_id)
select path[k + 1] as ancestor, row_id as descendant, k::int as distance from (select row_id, path, unnest(range(1, len(path))) k from t)""",
}
