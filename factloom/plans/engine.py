"""Queries for the engine's own operators, each over whole tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import paths, text
from factloom.operators import analysis, coherence, contracts, feed, fixpoint, hierarchy, nested, retained, rules, spans, tables, versions
from factloom.plans.records import _CURRENT, _FEED, _PLAIN
from factloom.plans.tables import table
from factloom.session import materialize, scratch_path
from factloom.sources import readers, sinks
from factloom.streaming import feed as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# spans: shipping periods of orders as intervals of days, per customer; order dates as points

_DAY = "timestamp_ntz'1990-01-01'"
_SPANS_SQL = """with i as (select o.o_custkey k, o.o_orderkey i_id, date_diff('day', timestamp '1990-01-01', min(l_shipdate)) i_start, date_diff('day', timestamp '1990-01-01', max(l_shipdate)) i_end
  from lineitem join orders o on l_orderkey = o.o_orderkey group by 1, 2),
p as (select o_custkey k, o_orderkey p_id, date_diff('day', timestamp '1990-01-01', o_orderdate) p_at from orders),
pairs as (select p_id, i_id, i_start, i_end from p join i on p.k = i.k and i_start <= p_at and i_end >= p_at)
"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    day = lambda c: F.expr(f"timestampdiff(DAY, {_DAY}, date_trunc('DAY', {c}))")
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    shipped = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    intervals = shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i_id"), day("a").alias("i_start"), day("b").alias("i_end"))
    points = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p_id"), day("o_orderdate").alias("p_start"), day("o_orderdate").alias("p_end"))
    return points, intervals


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    points, intervals = _spans(spark, d)
    return spans.containing(points, intervals, ["k"], slot=60)


@query(_SPANS_SQL + "select p_id, i_id from pairs")
def span_stab(spark, d):
    return _pairs(spark, d).select("p_id", "i_id")


@query(_SPANS_SQL + "select p_id, arg_min(i_id, (i_end - i_start) * 100000000 + i_id) picked from pairs group by 1")
def span_innermost(spark, d):
    return spans.innermost(_pairs(spark, d), ["p_id"], F.col("i_id"), F.col("i_id"))


@query(_SPANS_SQL + "select p_id, arg_max(i_id, (i_end - i_start) * 100000000 + i_id) picked from pairs group by 1")
def span_outermost(spark, d):
    return spans.outermost(_pairs(spark, d), ["p_id"], F.col("i_id"), F.col("i_id"))


@query(_SPANS_SQL + "select p_id, min(i_id) picked from pairs group by 1")
def span_first(spark, d):
    return spans.first_containing(_pairs(spark, d), ["p_id"], F.col("i_id"), F.col("i_id"))


@query(_SPANS_SQL + "select p_id from p where p_id in (select p_id from pairs)")
def span_exists(spark, d):
    points, intervals = _spans(spark, d)
    return spans.containing(points, intervals, ["k"], slot=60, how="left_semi").select("p_id")


@query(_SPANS_SQL + "select p_id from p where p_id not in (select p_id from pairs)")
def span_uncovered(spark, d):
    points, intervals = _spans(spark, d)
    return spans.containing(points, intervals, ["k"], slot=60, how="left_anti").select("p_id")


@query("""with e as (select distinct row_id, project_id, path, start_byte, end_byte from entities)
select a.row_id inner_id, b.row_id outer_id from e a join e b on a.project_id = b.project_id and a.path = b.path
and b.start_byte <= a.start_byte and b.end_byte >= a.end_byte and a.row_id <> b.row_id and a.start_byte <= a.end_byte""")
def nested_regions(spark, d):
    """Regions inside regions, the region itself left out: one row per region around it."""
    e = table(spark, d, "entities").select("row_id", "project_id", "path", "start_byte", "end_byte").distinct()
    points = e.select("project_id", "path", F.col("row_id").alias("inner_id"), F.col("start_byte").alias("p_start"), F.col("end_byte").alias("p_end"))
    intervals = e.select("project_id", "path", F.col("row_id").alias("outer_id"), F.col("start_byte").alias("i_start"), F.col("end_byte").alias("i_end"))
    return spans.containing(points, intervals, ["project_id", "path"], slot=512).where("inner_id <> outer_id").select("inner_id", "outer_id")


_LOCATION = ["project_id", "path", "start_byte", "end_byte"]


@query("select project_id, path, start_byte, end_byte, min(row_id) row_id from entities group by all")
def exact_first(spark, d):
    return spans.one_per_location(table(spark, d, "entities").select(*_LOCATION, "row_id"), _LOCATION, "row_id", last=False)


@query("select project_id, path, start_byte, end_byte, max(row_id) row_id, arg_max(coalesce(symbol, '?'), row_id) symbol from entities group by 1, 2, 3, 4")
def exact_last(spark, d):
    e = table(spark, d, "entities").select(*_LOCATION, "row_id", F.coalesce("symbol", F.lit("?")).alias("symbol"))
    return spans.one_per_location(e, _LOCATION, "row_id", last=True)


_DIGESTS = f"""with f as (select distinct file_id, project_id, {_PLAIN.format("path")} path, generation, 'sha256:' || sha256(source) h from source_files),
s as (select distinct project_id, {_PLAIN.format("path")} path, generation, 'sha256:' || regexp_replace(lower(trim(sha256)), '^sha256:', '') h from sources)
"""


@query(_DIGESTS + """select f.file_id, case when count(s.path) = 0 then 'missing' when bool_or(coalesce(f.h = s.h, false)) then 'coherent' else 'mismatch' end state
from f left join s on f.project_id = s.project_id and f.path = s.path and f.generation = s.generation where f.file_id is not null group by 1""")
def coherence_check(spark, d):
    """Source files against the delivered digests of their generation: coherent, mismatch or missing."""
    f = table(spark, d, "source_files").select("file_id", "project_id", paths.plain_path(F.col("path")).alias("path"), "generation", text.text_hash(F.col("source")).alias("h")).distinct()
    digest = F.concat(F.lit("sha256:"), F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", ""))
    s = table(spark, d, "sources").select(F.col("project_id").alias("s_project"), paths.plain_path(F.col("path")).alias("s_path"), F.col("generation").alias("s_generation"), digest.alias("s_h")).distinct()
    on = (F.col("project_id") == F.col("s_project")) & (F.col("path") == F.col("s_path")) & (F.col("generation") == F.col("s_generation"))
    equal = F.bool_or(F.coalesce(F.col("h") == F.col("s_h"), F.lit(False)))
    return f.join(s, on, "left").groupBy("file_id").agg(F.when(F.count("s_path") == 0, "missing").when(equal, "coherent").otherwise("mismatch").alias("state"))


@query("""with m as (select distinct origin_module as module from entities where origin_module <> ''),
c as (select distinct case when starts_with(module, '@') then array_to_string(list_slice(string_split(module, '/'), 1, 2), '/') else string_split(module, '/')[1] end as name from m union select module from m where length(module) % 2 = 0)
select m.module, arg_max(c.name, length(c.name)) as contract from m left join c on m.module = c.name or starts_with(m.module, c.name || '/') group by 1""")
def longest_prefix(spark, d):
    m = table(spark, d, "entities").where("origin_module <> ''").select(F.col("origin_module").alias("module")).distinct()
    c = m.select(paths.package_root(F.col("module")).alias("name")).union(m.where("length(module) % 2 = 0").select("module")).distinct()
    return contracts.longest_prefix(m, c)


@query("""with i as (select case when starts_with(origin_module, '@') then array_to_string(list_slice(string_split(origin_module, '/'), 1, 2), '/') else string_split(origin_module, '/')[1] end package, path, start_byte
  from entities where origin_module <> '' and path is not null and start_byte is not null)
select package, count(*) n_imports, arg_min(path, row(path, start_byte)) first_path, arg_min(start_byte, row(path, start_byte)) first_start from i where package <> 'solid-js' group by 1""")
def missing_contracts(spark, d):
    e = table(spark, d, "entities").where("origin_module <> '' and path is not null and start_byte is not null")
    imports = e.select(paths.package_root(F.col("origin_module")).alias("package"), "path", "start_byte")
    return contracts.missing(imports, spark.createDataFrame([("solid-js",)], "name string"))


@query("select distinct case when starts_with(origin_module, '@') then array_to_string(list_slice(string_split(origin_module, '/'), 1, 2), '/') else string_split(origin_module, '/')[1] end package from entities where origin_module <> ''")
def package_roots(spark, d):
    return table(spark, d, "entities").where("origin_module <> ''").select(paths.package_root(F.col("origin_module")).alias("package")).distinct().orderBy("package")


# aliases

_ROOTS = "with recursive " + _CURRENT + """, t as (select row_id, row_id as root, 0::bigint as hops from e where parent is null
union all select e.row_id, t.root, t.hops + 1 from e join t on e.parent = t.row_id)
"""


def _aliases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Current symbols and the links between them, kept as tables, since the loops and what follows them read both again."""
    folder = scratch_path(spark, "aliases")
    current = materialize(hierarchy.current_symbols(table(spark, d, "symbols")), f"{folder}/current")
    return current, materialize(hierarchy.alias_edges(current), f"{folder}/edges")


@query(_ROOTS + "select e.row_id node, t.root, t.hops from e left join t using (row_id) where e.parent is not null")
def alias_roots(spark, d):
    return fixpoint.roots_by_doubling(_aliases(spark, d)[1])


@query(_ROOTS + "select t.root, count(*) n_symbols, list_sort(list(t.row_id)) members from t where hops > 0 group by 1")
def symbols_by_root(spark, d):
    roots = fixpoint.roots_by_doubling(_aliases(spark, d)[1]).where("root is not null")
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("n_symbols"), F.sort_array(F.collect_list("node")).alias("members"))


@query("with recursive " + _CURRENT + """, k as (select row_id node, 'declared' tag from e where row_id in (select row_id from symbols where declarations[1].kind = 'function')
union select e.row_id, k.tag from e join k on e.parent = k.node) select node, tag from k""")
def alias_propagate(spark, d):
    """Symbols declared as functions, and everything that is an alias of them."""
    current, edges = _aliases(spark, d)
    declared = table(spark, d, "symbols").where("declarations[0].kind = 'function'").select(F.col("row_id").alias("node")).distinct()
    seeds = current.join(declared, "node", "left_semi").select("node", F.lit("declared").alias("tag"))
    return fixpoint.spread(seeds, edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query(_ROOTS.rstrip() + """, refs as (select s.row_id, unnest(s.reference_locs) r from (select distinct on (row_id) row_id, reference_locs from symbols) s),
g as (select t.root, struct_pack(path := r.path, start_byte := r.start_byte, end_byte := r.end_byte) r from refs join t using (row_id) where r is not null)
select root, list_sort(list(distinct r)) reference_locs from g group by 1""")
def group_refs(spark, d):
    """References by canonical root, sorted, each once."""
    current, edges = _aliases(spark, d)
    roots = fixpoint.roots_by_doubling(edges).where("root is not null").select("node", "root")
    every = current.select("node").join(edges, F.col("node") == F.col("child"), "left_anti").select("node", F.col("node").alias("root")).unionByName(roots)
    refs = table(spark, d, "symbols").dropDuplicates(["row_id"]).select(F.col("row_id").alias("node"), F.explode("reference_locs").alias("r")).where("r is not null")
    return refs.join(every, "node").groupBy("root").agg(F.sort_array(F.collect_set("r")).alias("reference_locs"))


@query("""select project_id, id, arg_min(struct_pack(path := l.path, start_byte := l.start_byte), row(l.path, l.start_byte)) first_declaration from
(select distinct project_id, id, unnest(declarations)."location" l from symbols) where l is not null and l.path is not null and l.start_byte is not null group by 1, 2""")
def argmin_decl(spark, d):
    decl = table(spark, d, "symbols").select("project_id", "id", F.explode("declarations").alias("x")).select("project_id", "id", "x.location.path", "x.location.start_byte")
    return decl.where("path is not null and start_byte is not null").groupBy("project_id", "id").agg(F.min(F.struct("path", "start_byte")).alias("first_declaration"))


# the graph of events: same user, the next events within two hours

_EDGES_SQL = """e as (select a.event_id src, b.event_id dst, a.event_type kind from events a join events b
on a.user_id = b.user_id and b.ts > a.ts and epoch_us(b.ts) - epoch_us(a.ts) <= 7200000000)
"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return events, spans.near_in_time(events, "user_id", "ts", "event_id", 7200)


@query("""with a as (select 'n' || s_nationkey n, 's' || s_suppkey s from supplier), b as (select distinct 's' || l_suppkey s, 'p' || l_partkey p from lineitem), c as (select distinct 'p' || l_partkey p, 'o' || l_orderkey o from lineitem),
x as (select n as root, n as node, 1 as k from (select distinct n from a) union all select n, s, 1 from (select distinct n, s from a) union all select n, p, count(*) from (select distinct n, s from a) join b using (s) group by 1, 2
  union all select n, o, count(*) from (select distinct n, s from a) join b using (s) join c using (p) group by 1, 2) select root, node, sum(k)::bigint n_paths from x group by 1, 2""")
def reach_paths(spark, d):
    """Paths from each nation over its suppliers and their parts to all orders of these: the number of paths to every node, of any length."""
    lines, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation = s.select(of("n", "s_nationkey").alias("src"), of("s", "s_suppkey").alias("dst")).distinct()
    parts = lines.select(of("s", "l_suppkey").alias("src"), of("p", "l_partkey").alias("dst")).distinct()
    orders = lines.select(of("p", "l_partkey").alias("src"), of("o", "l_orderkey").alias("dst")).distinct()
    return fixpoint.path_counts(nation.select(F.col("src").alias("node")).distinct(), nation.union(parts).union(orders))


@query("with recursive " + _EDGES_SQL + """, t as (select event_id node from events where event_type = 'signup' union select e.dst from t join e on e.src = t.node) select node from t""")
def reach_set(spark, d):
    events, edges = _graph(spark, d)
    return fixpoint.spread(events.where("event_type = 'signup'").select(F.col("event_id").alias("node"), F.lit(0).alias("tag")), edges).select("node")


@query("with recursive " + _EDGES_SQL + """, t as (select event_id node from events where event_type = 'error' union select e.src from t join e on e.dst = t.node) select node from t""")
def affected_set(spark, d):
    """Backwards: everything that leads to an error."""
    events, edges = _graph(spark, d)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.spread(events.where("event_type = 'error'").select(F.col("event_id").alias("node"), F.lit(0).alias("tag")), back).select("node")


@query("with recursive " + _EDGES_SQL + """, x as (select src, dst, case kind when 'view' then 1 when 'click' then 2 when 'purchase' then 4 end sets from e),
t as (select event_id node, case event_type when 'signup' then 1 else 2 end bit from events where event_type in ('signup', 'error')
union select x.dst, unnest(case when x.sets is null then [t.bit] else [x.sets] end) from t join x on x.src = t.node)
select node, bit_or(bit)::int context from t group by 1""")
def lattice_fixpoint(spark, d):
    events, edges = _graph(spark, d)
    sets = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 4)
    labelled = edges.join(events.select(F.col("event_id").alias("src"), sets.alias("sets")), "src")
    seeds = events.where("event_type in ('signup', 'error')").select(F.col("event_id").alias("node"), F.when(F.col("event_type") == "signup", 1).otherwise(2).alias("context"))
    return fixpoint.lattice(seeds, labelled)


@query("with recursive " + _EDGES_SQL + """, t as (select event_id node, event_id tag from events where event_type = 'signup' union select e.dst, t.tag from t join e on e.src = t.node)
select node, list_sort(list(distinct tag)) roots from t group by 1""")
def summary_closure(spark, d):
    """The signups upstream of each event."""
    events, edges = _graph(spark, d)
    seeds = events.where("event_type = 'signup'").select(F.col("event_id").alias("node"), F.col("event_id").alias("tag"))
    return fixpoint.spread(seeds, edges).groupBy("node").agg(F.sort_array(F.collect_set("tag")).alias("roots"))


# findings

@query("""with f as (select distinct project_id, rule, primary_location.path path, primary_location.start_byte start_byte, record_id from findings where primary_location is not null)
select project_id, rule, path, start_byte, min(record_id) record_id from f group by 1, 2, 3, 4""")
def first_seen(spark, d):
    f = table(spark, d, "findings").where("primary_location is not null").select("project_id", "rule", F.col("primary_location.path").alias("path"), F.col("primary_location.start_byte").alias("start_byte"), "record_id").distinct()
    return tables.first_seen(f, ["project_id", "rule", "path", "start_byte"], "record_id")


@query("select path, count(*) n, bool_or(call_target is not null) any_call, count(distinct symbol) n_symbols from entities group by 1")
def entity_groups(spark, d):
    return table(spark, d, "entities").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("call_target").isNotNull()).alias("any_call"), F.countDistinct("symbol").alias("n_symbols"))


@query("""with s as (select event_type, list_sort(list(value)) v from events where value is not null group by 1)
select event_type, round(v[((len(v) - 1) * 50) // 100 + 1], 6) p50, round(v[((len(v) - 1) * 95) // 100 + 1], 6) p95 from s""")
def percentile_floor(spark, d):
    """sorted[(n - 1) * p / 100] by position: ranks are made by counts of equal values, not by one task sorting all."""
    e = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    n_all = e.groupBy("event_type").agg(F.sum("n").alias("total"))
    slot = F.floor(F.col("value")).cast("bigint")
    cells = e.groupBy("event_type", slot.alias("slot")).agg(F.sum("n").alias("n"))
    from pyspark.sql import Window as W

    before = cells.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("event_type").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = W.partitionBy("event_type", "slot").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    ranked = e.withColumn("slot", slot).join(before, ["event_type", "slot"]).withColumn("lo", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).join(n_all, "event_type")
    at = lambda p: F.round(F.max(F.when((F.col("lo") <= F.floor((F.col("total") - 1) * p / 100)) & (F.floor((F.col("total") - 1) * p / 100) < F.col("lo") + F.col("n")), F.col("value"))), 6)
    return ranked.groupBy("event_type").agg(at(50).alias("p50"), at(95).alias("p95"))


@query("select l_orderkey, l_linenumber, unnest(range(1, 1 + floor(l_quantity)::int))::int copy from lineitem where l_quantity >= 1")
def multiplicity_expand(spark, d):
    """Every line once per unit of its quantity, without a bound; a null quantity or one below 1 gives no row."""
    return table(spark, d, "lineitem").where("l_quantity >= 1").select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1), F.floor("l_quantity").cast("int"))).alias("copy"))


@query("""with a as (select distinct record_id, unnest(range(len(a)))::int pos, unnest(a) e from (select record_id, case json_type(j, '$.calls') when 'ARRAY' then cast(j->'$.calls' as json[]) when 'OBJECT' then [j->'$.calls'] else [] end a
  from (select record_id, try_cast(payload as json) j from file_facts where payload is not null) where json_type(j) = 'OBJECT')),
c as (select record_id, pos, e->>'$.target' target, case json_type(e, '$.arguments') when 'ARRAY' then json_array_length(e, '$.arguments') when 'OBJECT' then 1 else 0 end n_args from a where json_type(e) = 'OBJECT')
select target, count(*) n_sites, max(n_args)::int most_arguments from c where target is not null group by 1""")
def callsite_targets(spark, d):
    """Call sites per target with the greatest number of arguments."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    v = table(spark, d, "file_facts").where("payload is not null").select("record_id", nested.parse_object(F.col("payload")).alias("v")).where("v is not null")
    calls = v.select("record_id", F.posexplode(nested._elements(F.try_variant_get("v", "$.calls", "variant"))).alias("pos", "e")).where("e is not null")
    a = F.try_variant_get("e", "$.arguments", "array<variant>")
    n = F.when(a.isNotNull(), F.size(a)).when(F.schema_of_variant(F.try_variant_get("e", "$.arguments", "variant")).startswith("OBJECT"), 1).otherwise(0)
    once = calls.select("record_id", "pos", F.try_variant_get("e", "$.target", "string").alias("target"), n.alias("n_args")).distinct()
    return once.where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n_sites"), F.max("n_args").alias("most_arguments"))


# tables of two generations, derived from orders

_OLD = "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 3"
_NEW = "select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 4"


def _generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 <> 4").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return o.where("o_orderkey % 10 <> 3"), new


@query(f"""with a as ({_OLD}), b as ({_NEW}) select coalesce(b.o_orderkey, a.o_orderkey) o_orderkey, case when b.o_orderkey is null then 'removed' else 'changed' end op, b.o_orderstatus, b.o_totalprice
from a full join b on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or row(a.o_orderstatus, a.o_totalprice) is distinct from row(b.o_orderstatus, b.o_totalprice)""")
def table_diff(spark, d):
    return tables.keyed_diff(*_generations(spark, d), ["o_orderkey"])


@query(_NEW)
def table_apply(spark, d):
    """apply(diff(old, new), old) is new."""
    old, new = _generations(spark, d)
    return tables.keyed_apply(old, tables.keyed_diff(old, new, ["o_orderkey"]), ["o_orderkey"])


@query(f"""with a as ({_OLD}), b as ({_NEW}) select * from a where o_orderkey % 100 >= 20 union all select * from b where o_orderkey % 100 < 20""")
def group_replace(spark, d):
    old, new = _generations(spark, d)
    old, new = (x.withColumn("g", F.col("o_orderkey") % 100) for x in (old, new))
    return tables.replace_groups(old, new, ["g"], spark.range(20).select(F.col("id").alias("g"))).drop("g")


@query(f"""with a as (select o_orderkey from ({_OLD})), b as (select o_orderkey from ({_NEW})) (select 'added' side, o_orderkey from b except select 'added', o_orderkey from a)
union all (select 'gone', o_orderkey from a except select 'gone', o_orderkey from b)""")
def set_changes(spark, d):
    old, new = (x.select("o_orderkey") for x in _generations(spark, d))
    return new.exceptAll(old).select(F.lit("added").alias("side"), "o_orderkey").unionByName(old.exceptAll(new).select(F.lit("gone").alias("side"), "o_orderkey"))


@query(f"""with a as (select *, o_orderkey % 1000 g from ({_OLD})), b as (select *, o_orderkey % 1000 g from ({_NEW})), x as (select g, list_sort(list(row(o_orderkey, o_orderstatus, o_totalprice))) v from a group by 1),
y as (select g, list_sort(list(row(o_orderkey, o_orderstatus, o_totalprice))) v from b group by 1) select coalesce(x.g, y.g) g from x full join y on x.g = y.g where x.v is distinct from y.v""")
def demand_delta(spark, d):
    old, new = (x.withColumn("g", F.col("o_orderkey") % 1000) for x in _generations(spark, d))
    return tables.changed_groups(old, new, ["g"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(f"""with a as ({_OLD}), o as (select o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 5 = 0 deleted from orders where o_orderkey % 3 = 0)
select * from a where o_orderkey not in (select o_orderkey from o) union all select o_orderkey, o_orderstatus, o_totalprice from o where not deleted""")
def overlay_view(spark, d):
    base, _ = _generations(spark, d)
    over = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 5 == 0).alias("deleted"))
    return tables.overlay(base, over, ["o_orderkey"])


# the versioned feed

@query(_FEED + "select project_id, path, version, deleted from k where n = 1")
def latest_version(spark, d):
    return feed.decisive_changes(table(spark, d, "updates")).select("project_id", "path", "version", "deleted")


_LOG = _FEED + """, u as (select distinct change_id, r.project_id, r.path, r.version, b.batch from r join (select distinct change_id, batch from updates) b using (change_id) where r.version is not null and r.path is not null),
w as (select *, max(version) over (partition by project_id, path order by change_id rows between unbounded preceding and 1 preceding) highest_before from u)
"""


@query(_LOG + """select *, sum(case when n_applied > 0 then 1 else 0 end) over (partition by project_id order by batch nulls first)::bigint generation from
(select project_id, batch, count(*) n_changes, count(*) filter (coalesce(version > highest_before, true)) n_applied from w group by 1, 2)""")
def generation_log(spark, d):
    return versions.generation_log(table(spark, d, "updates"))


@query(_LOG + "select change_id, project_id, path, version, highest_before from w where version <= highest_before")
def stale_changes(spark, d):
    return versions.stale_changes(table(spark, d, "updates"))


@query(_FEED + "select project_id, path, version, deleted, source from k where n = 1")
def affected_recompute(spark, d):
    updates = table(spark, d, "updates")
    low, high = updates.agg(F.min("change_id"), F.max("change_id")).first()
    return versions.recompute_changed(updates, (low + high) // 2)


@query(_FEED + "select project_id, path, version from k where n = 1 and not deleted")
def stream_files(spark, d):
    """The feed as a stream in micro-batches: the same files as from one batch."""
    folder = scratch_path(spark, "stream")
    store = feed.BucketedTable(spark, f"{folder}/files", feed.buckets_for(table(spark, d, "updates").count()))
    stream.apply_stream(stream.read_changes(spark, d, "updates.parquet"), store, f"{folder}/checkpoint", once=True).awaitTermination()
    return store.current().select("project_id", "path", "version")


# bytes and texts

@query("""select doc_id, 'sha256:' || sha256(text) h, 'sha256:' || sha256(text) parsed from documents""")
def text_hash(spark, d):
    h = text.text_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("h"), text.parsed_hash(h).alias("parsed"))


def _line_starts(t: Column) -> Column:
    """Byte offsets of the starts of a text's lines; the empty text has one line."""
    last = F.size(F.split(t, "\n")) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == 0, 0).otherwise(F.octet_length(F.call_function("substring_index", t, F.lit("\n"), k)) + 1))


_TEXT_LINES = """l as (select doc_id, text, string_split(text, chr(10)) a from documents where text is not null),
st as (select doc_id, text, a, list_transform(range(len(a)), lambda k: coalesce(list_sum(list_transform(a[1:k], lambda x: octet_length(encode(x)) + 1)), 0)::int) starts, octet_length(encode(text))::int size from l)
"""


@query(f"""with {_TEXT_LINES},
o as (select doc_id, unnest(list_distinct(list_concat(starts, [size // 2, size, size + 1]))) at_offset from st),
x as (select doc_id, at_offset, hex(encode(text)) h, least(at_offset, size) b, size from o join st using (doc_id)),
y as (select *, case when b < size then (select min(k) from range(4) t(k) where h[2 * (b - k) + 1:2 * (b - k) + 1] not in ('8', '9', 'A', 'B')) else 0 end back from x),
w as (select *, decode(from_hex(left(h, 2 * (b - back)::int))) t from y)
select doc_id, at_offset, (1 + length(t) - length(replace(t, chr(10), '')))::bigint line_no,
(1 + length(string_split(t, chr(10))[-1]) + length(regexp_replace(string_split(t, chr(10))[-1], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::bigint col_no from w""")
def line_col(spark, d):
    """1-based line and UTF-16 column of every line start, the middle, the end and past the end of every text; null texts have no offsets."""
    size = F.octet_length("text")
    offsets = F.array_distinct(F.concat(_line_starts(F.col("text")), F.array(F.floor(size / 2).cast("int"), size, size + 1)))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.explode(offsets).alias("at_offset"))
    return t.select("doc_id", "at_offset", text.line_number(F.col("text"), F.col("at_offset")).alias("line_no"), text.utf16_column(F.col("text"), F.col("at_offset")).alias("col_no"))


@query(f"""with {_TEXT_LINES},
o as (select doc_id, unnest(list_distinct(list_concat(list_transform(a, lambda x, k: {{'s': starts[k], 'e': (starts[k] + octet_length(encode(x)))::int}}),
  [{{'s': size // 2, 'e': size // 2 + 9}}, {{'s': 0, 'e': size}}, {{'s': size, 'e': size + 1}}]))) p from st),
x as (select doc_id, p.s start_byte, p.e end_byte, hex(encode(text)) h, size from o join st using (doc_id))
select doc_id, start_byte, end_byte, case when end_byte <= size and h[2 * start_byte + 1:2 * start_byte + 1] not in ('8', '9', 'A', 'B') and h[2 * end_byte + 1:2 * end_byte + 1] not in ('8', '9', 'A', 'B')
then decode(from_hex(h[2 * start_byte + 1:2 * end_byte])) end slice from x""")
def byte_slice(spark, d):
    """Every line, nine bytes from the middle, the whole and one byte past the end of every text, cut by byte offsets; null outside or where a character would be split."""
    size, middle = F.octet_length("text"), F.floor(F.octet_length("text") / 2).cast("int")
    span = lambda a, b: F.struct(a.alias("start_byte"), b.alias("end_byte"))
    lines = F.zip_with(_line_starts(F.col("text")), F.split("text", "\n"), lambda a, x: span(a, a + F.octet_length(x)))
    spans = F.array_distinct(F.concat(lines, F.array(span(middle, middle + 9), span(F.lit(0), size), span(size, size + 1))))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.explode(spans).alias("p")).select("doc_id", "text", "p.*")
    return t.select("doc_id", "start_byte", "end_byte", text.byte_slice(F.col("text"), F.col("start_byte"), F.col("end_byte")).alias("slice"))


@query("""select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: '<' || (k - 1) || '>' || substr(x, length(x) // 2 + 1)), chr(10)) edited from documents""")
def apply_edits(spark, d):
    """In every line of every text the first half of the characters is replaced by the line's number; a null text stays null."""
    t = F.col("text")
    half = lambda x: F.octet_length(F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int")))
    lines = F.zip_with(_line_starts(t), F.split(t, "\n"), lambda a, x: F.struct(a.alias("start"), (a + half(x)).alias("end")))
    edits = F.transform(lines, lambda e, k: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.concat(F.lit("<"), k.cast("string"), F.lit(">")).alias("new_text")))
    return table(spark, d, "documents").select("doc_id", text.apply_edits(t, edits).alias("edited"))


@query(f"select distinct path, {_PLAIN.format('path')} plain, lower(nullif(regexp_extract(path, '[^/\\\\](\\.[^./\\\\]+)$', 1), '')) ext from sources where path is not null")
def plain_paths(spark, d):
    s = table(spark, d, "sources").where("path is not null").select("path").distinct()
    return s.select("path", paths.plain_path(F.col("path")).alias("plain"), paths.file_extension(F.col("path")).alias("ext"))


@query()
def markup_elements(spark, d):
    return readers.markup_elements(table(spark, d, "documents"), "doc_id")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_facts(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("j")).select("event_id", "j.k")


@query("""select file_id, case when file_id % 4 = 1 then 'protocol' when file_id % 4 = 2 then 'source hash' when file_id % 4 = 3 then 'trackedRegions outside' end problem
from (select distinct file_id from source_files where source is not null)""")
def map_problems(spark, d):
    """Execution maps made for every source file, three of four of them with a known fault."""
    f = table(spark, d, "source_files").where("source is not null").select("file_id", "source").dropDuplicates(["file_id"])
    m = F.col("file_id") % 4
    size = F.octet_length("source")
    body = F.struct(
        F.when(m == 1, 9).otherwise(1).alias("compilerFactsProtocol"),
        F.when(m == 2, "sha256:0").otherwise(text.text_hash(F.col("source"))).alias("sourceHash"),
        F.array(F.struct(F.lit(0).alias("start"), F.when(m == 3, size + 1).otherwise(size).alias("end"), F.lit("markup").alias("reason"))).alias("trackedRegions"),
    )
    return readers.execution_maps(f.withColumn("map_json", F.to_json(body))).select("file_id", "problem")


@query("""select name, arg_min(place, row(tier, place)) place, min(tier)::int tier from (select distinct origin_module as name, (row_id % 3)::int as tier, project_id as place from entities where origin_module <> '') group by 1""")
def contract_tiers(spark, d):
    offers = table(spark, d, "entities").where("origin_module <> ''").select(F.col("origin_module").alias("name"), (F.col("row_id") % 3).cast("int").alias("tier"), F.col("project_id").alias("place")).distinct()
    return contracts.by_tier(offers).select("name", "place", "tier")


@query("""select record_id, case record_id % 3 when 0 then null when 1 then 'unknown evidence' else 'unknown kind of export' end problem from (select distinct record_id, rule from findings where rule <> '')""")
def contract_json(spark, d):
    """A contract written as JSON for every finding's rule, two of three of them faulty, decoded and judged."""
    f = table(spark, d, "findings").where("rule <> ''").select("record_id", "rule").distinct()
    m = F.col("record_id") % 3
    exports = F.create_map(F.lit("x"), F.struct(F.when(m == 2, "other").otherwise("function").alias("kind")))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.col("rule").alias("name")).alias("package"), exports.alias("exports"), F.struct(F.when(m == 1, "guess").otherwise("reviewed").alias("kind")).alias("evidence"))
    return contracts.decode(f.select("record_id", F.to_json(body).alias("text"))).select("record_id", "problem")


@query("""select project_id package, case when bool_or(generation is null) then null else count(distinct rule) end n_exports from findings where rule <> '' and project_id is not null group by 1""")
def contract_emit(spark, d):
    """Contracts per project from the rules of its findings, refused if one has no generation; read again and counted."""
    f = table(spark, d, "findings").where("rule <> '' and project_id is not null")
    s = f.groupBy("project_id", "rule").agg(F.bool_or(F.col("generation").isNull()).alias("unresolved"))
    made = contracts.emit(s.select(F.col("project_id").alias("package"), F.lit("1").alias("version"), F.col("rule").alias("export"), F.lit("function").alias("kind"), "unresolved"))
    return made.select("package", F.from_json("text", contracts.CONTRACT).alias("c")).select("package", F.when(F.col("c").isNotNull(), F.size("c.exports")).cast("bigint").alias("n_exports"))


@query("""select * from (values
('SC1001', 'strict-read-untracked', 'warning', false),
('SC1002', 'reactive-read-after-await', 'error', false),
('SC1003', 'component-props-destructure', 'error', false),
('SC1004', 'component-returns-conditionally', 'error', false),
('SC2001', 'reactive-write-in-owned-scope', 'error', false),
('SC2002', 'action-called-in-owned-scope', 'error', false),
('SC3001', 'cleanup-in-forbidden-scope', 'error', false),
('SC3002', 'primitive-in-leaf-owner', 'error', false),
('SC3003', 'flush-in-forbidden-scope', 'error', false),
('SC3004', 'invalid-cleanup-return', 'error', false),
('SC3005', 'settled-cleanup-unowned', 'error', false),
('SC4001', 'no-owner-effect', 'warning', false),
('SC4002', 'no-owner-cleanup', 'warning', false),
('SC4003', 'no-owner-boundary', 'warning', false),
('SC5001', 'pending-async-untracked-read', 'error', false),
('SC5002', 'pending-async-forbidden-scope', 'warning', false),
('SC5003', 'async-outside-loading-boundary', 'warning', false),
('SC6001', 'primitive-in-directive-application', 'error', false),
('SC7001', 'missing-effect-function', 'error', false),
('SC7002', 'sync-node-received-async', 'error', false),
('SC7003', 'invalid-refresh-target', 'error', false),
('SC7003', 'invalid-affects-target', 'error', false),
('SC7004', 'affects-keys-on-accessor', 'error', false),
('SC9001', 'package-contract-export-missing', 'error', true),
('SC9002', 'cleanup-return-unresolved', 'error', true),
('SC9003', 'refresh-target-unresolved', 'error', true),
('SC9003', 'affects-target-unresolved', 'error', true),
('SC9004', 'execution-map-incomplete', 'error', true),
('SC9005', 'package-contract-missing', 'error', true)
) t(code, rule, severity, uncertifiable)""")
def rule_catalogue(spark, d):
    return rules.catalogue(spark)


@query(f"""with s as (select project_id, {_PLAIN.format("path")} path, arg_min(source, file_id) source from source_files where source is not null and project_id is not null and path is not null group by 1, 2),
f as (select distinct project_id, {_PLAIN.format("primary_location.path")} path, primary_location.start_byte b from findings where primary_location.path is not null and primary_location.start_byte is not null and project_id is not null),
x as (select f.*, source, hex(encode(source)) h from f left join s on f.project_id = s.project_id and f.path = s.path),
y as (select *, greatest(0, least(b, length(h) // 2)) at_ from x),
z as (select *, case when at_ < length(h) // 2 then (select min(k) from range(4) t(k) where h[2 * (at_ - k) + 1:2 * (at_ - k) + 1] not in ('8', '9', 'A', 'B')) else 0 end back from y),
w as (select *, decode(from_hex(left(h, 2 * (at_ - back)::int))) t from z)
select project_id, path, b as start_byte, (1 + length(t) - length(replace(t, chr(10), '')))::bigint line_no,
(1 + length(string_split(t, chr(10))[-1]) + length(regexp_replace(string_split(t, chr(10))[-1], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::bigint col_no from w""")
def finding_lines(spark, d):
    """Line and UTF-16 column of every position of a finding, in files with any characters; nulls where the file is unknown.

    Paths are met whatever their spelling; of several texts of a file the one with the lowest file_id counts. An offset
    past the end counts as the end, one inside a character as the character's first byte.
    """
    s = table(spark, d, "source_files").where("source is not null and project_id is not null and path is not null")
    s = s.groupBy("project_id", paths.plain_path(F.col("path")).alias("path")).agg(F.min_by("source", "file_id").alias("source"))
    f = table(spark, d, "findings").where("project_id is not null and primary_location.path is not null and primary_location.start_byte is not null")
    f = f.select("project_id", paths.plain_path(F.col("primary_location.path")).alias("path"), F.col("primary_location.start_byte").alias("start_byte")).distinct()
    return sinks.located(f, s)


# further joins and sessions

@query("""select distinct row_id, origin_module = 'solid-js' is true or coalesce(list_bool_or(list_transform(alias_declarations, lambda x: contains(lower(x."location".path), '/node_modules/solid-js/'))), false) typed from entities""")
def typed_accessors(spark, d):
    e = table(spark, d, "entities")
    return e.select("row_id", analysis.typed_accessor(F.col("origin_module"), F.col("alias_declarations")).alias("typed")).distinct()


@query(f"""with f as (select project_id, path, x.h sha256, x.g generation from (select project_id, {_PLAIN.format("path")} path, arg_min({{'h': 'sha256:' || sha256(source), 'g': generation}}, file_id) x from source_files
  where project_id is not null and path is not null and source is not null group by 1, 2)),
s as (select project_id, {_PLAIN.format("path")} path, 'sha256:' || regexp_replace(lower(trim(sha256)), '^sha256:', '') sha256, generation, delivered_at from sources),
j as (select f.project_id, f.path, s.sha256, s.generation, rank() over (partition by f.project_id, f.path
  order by case when s.generation = f.generation then 0 else 1 end, case when s.generation >= 1 then s.generation end desc nulls last, s.delivered_at desc nulls last) k
  from f join s on f.project_id = s.project_id and f.path = s.path),
a as (select project_id, path, count(*) n, min(sha256) h, min(generation) g from (select distinct project_id, path, sha256, generation from j where k = 1) group by 1, 2)
select f.project_id, f.path, case when a.n is null then 'digests missing' when a.n > 1 then 'digests repeated' when a.h is distinct from f.sha256 then 'digests hash' when a.g is distinct from f.generation then 'digests generation' end problem
from f left join a on f.project_id = a.project_id and f.path = a.path""")
def domain_join(spark, d):
    """Files against the digests of every generation, in the diagnostic mode.

    A file is judged by its own generation; where its path was not delivered in that, by the latest one it was delivered in, and
    by rows without a usable generation only if there are no others. Within a generation the last delivery counts, a null
    delivered_at is the earliest, and different digests delivered at once are repeated. Digests are compared whatever their
    spelling; a null one equals none. A file without a generation is judged by the latest.
    """
    f = table(spark, d, "source_files").where("project_id is not null and path is not null and source is not null")
    f = f.groupBy("project_id", paths.plain_path(F.col("path")).alias("path")).agg(F.min_by(F.struct(text.text_hash(F.col("source")).alias("sha256"), "generation"), "file_id").alias("x"))
    f = f.select("project_id", "path", "x.sha256", "x.generation")
    digest = F.concat(F.lit("sha256:"), F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", ""))
    s = table(spark, d, "sources").select("project_id", paths.plain_path(F.col("path")).alias("path"), digest.alias("sha256"), "generation", "delivered_at")
    own = F.when(F.col("generation") == F.col("of"), 0).otherwise(1)
    best = Window.partitionBy("project_id", "path").orderBy(own, F.when(F.col("generation") >= 1, F.col("generation")).desc_nulls_last(), F.col("delivered_at").desc_nulls_last())
    s = s.join(f.select("project_id", "path", F.col("generation").alias("of")), ["project_id", "path"]).withColumn("k", F.rank().over(best)).where("k = 1")
    s = s.select("project_id", "path", "sha256", "generation").distinct().withColumn("facts", F.lit(1))
    return coherence.join_domains(f, {"digests": s}, strict=False).select("project_id", "path", "problem")


@query("""with e as (select distinct row_id, project_id, path, start_byte, end_byte, symbol from entities where start_byte <= end_byte),
f as (select * from e where symbol <> ''),
j as (select b.row_id, f.symbol, row_number() over (partition by b.row_id order by case when f.start_byte = b.start_byte and f.end_byte = b.end_byte then 0 else 1 end, f.end_byte - f.start_byte, f.row_id) k
  from e b join f on b.project_id = f.project_id and b.path = f.path and f.start_byte >= b.start_byte and f.end_byte <= b.end_byte)
select e.row_id, j.symbol found from e left join j on e.row_id = j.row_id and k = 1""")
def smallest_contained(spark, d):
    e = table(spark, d, "entities").where("start_byte <= end_byte").select("row_id", "project_id", "path", "start_byte", "end_byte", "symbol").distinct()
    boxes = e.where("project_id is not null and path is not null").select("row_id", "project_id", "path", F.col("start_byte").alias("i_start"), F.col("end_byte").alias("i_end"))
    facts = e.where("symbol <> ''").select("project_id", "path", F.col("start_byte").alias("p_start"), F.col("end_byte").alias("p_end"), "symbol", F.col("row_id").alias("o"))
    nowhere = e.where("project_id is null or path is null").select("row_id", F.lit(None).cast("string").alias("found"))
    return spans.smallest_contained(boxes, facts, ["project_id", "path"], 512, "symbol", "o").select("row_id", "found").unionByName(nowhere)


@query(_NEW)
def retained_states(spark, d):
    """Two generations of a retained table; the client goes from nothing to the first and by a delta to the second."""
    old, new = _generations(spark, d)
    kept = retained.RetainedTable(scratch_path(spark, "retained"), ["o_orderkey"])
    kept.update(1, old)
    first = kept.exchange(None)
    held = kept.receive(None, first)
    kept.update(2, new)
    return kept.receive(held, kept.exchange(first.token))


@query("""with recursive i as (select distinct project_id || ':' || id path, project_id || ':' || alias_target target from symbols where alias_target <> ''),
t as (select distinct project_id || ':' || id path from symbols where id like '%7' union select i.path from i join t on i.target = t.path) select path from t""")
def affected_files(spark, d):
    """Everything that refers, over any number of steps, to a symbol whose id ends in 7."""
    s = table(spark, d, "symbols")
    full = lambda c: F.concat_ws(":", "project_id", c)
    imports = s.where("alias_target <> ''").select(full("id").alias("path"), full("alias_target").alias("target")).distinct()
    return retained.affected_files(s.where("id like '%7'").select(full("id").alias("path")).distinct(), imports, imports.limit(0))


@query("""with e as (select distinct row_id, project_id, path, start_byte, end_byte, type_text from entities),
b as (select * from e where type_text = 'unknown'), r as (select * from e where type_text like 'Accessor%' and project_id is not null and path is not null and start_byte is not null and end_byte is not null)
select r.row_id, exists (select 1 from b where b.project_id = r.project_id and b.path = r.path and b.start_byte <= r.start_byte and b.end_byte >= r.end_byte and r.start_byte <= r.end_byte) under_loading from r""")
def under_boundary(spark, d):
    e = table(spark, d, "entities").select("row_id", "project_id", "path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "type_text").distinct()
    reads = e.where("type_text like 'Accessor%' and project_id is not null and path is not null and start is not null and `end` is not null").drop("type_text")
    return analysis.under_boundary(reads, e.where("type_text = 'unknown'")).select("row_id", "under_loading")


@query("""with a as (select distinct record_id, unnest(range(len(a)))::int pos, unnest(a) e from (select record_id, case json_type(j, '$.calls') when 'ARRAY' then cast(j->'$.calls' as json[]) when 'OBJECT' then [j->'$.calls'] else [] end a
  from (select record_id, try_cast(payload as json) j from file_facts where payload is not null) where json_type(j) = 'OBJECT')),
g as (select record_id, pos site, e->>'$.target' target, unnest(range(len(x)))::int pos, unnest(x) v from (select *, case json_type(e, '$.arguments') when 'ARRAY' then cast(e->'$.arguments' as json[]) when 'OBJECT' then [e->'$.arguments'] else [] end x from a where json_type(e) = 'OBJECT'))
select record_id, site, pos, 'tracked' execution from g where json_type(v) = 'OBJECT' and target is not null and pos = length(target) % 2""")
def callback_forwarding(spark, d):
    """Arguments that their call's target runs: matched by target and argument index."""
    o = nested.file_fact_occurrences(table(spark, d, "file_facts"))
    calls = o.where("child = 'call'").select("record_id", F.col("pos_1").alias("site"), F.get_json_object("body", "$.target").alias("callee_root"))
    args = o.where("child = 'call_argument'").select("record_id", F.col("pos_1").alias("site"), F.col("pos_2").alias("pos")).join(calls, ["record_id", "site"])
    known = calls.where("callee_root is not null").select(F.col("callee_root").alias("root"), (F.length("callee_root") % 2).alias("parameter"), F.lit("tracked").alias("execution")).distinct()
    return analysis.forwarded(args, known).select("record_id", "site", "pos", "execution")
