"""The analysis over whole tables: every relation of :class:`Analysis`, with the same result in SQL.

The facts are those of a program laid out from the trade tables. A customer is a file, days are bytes. An
order is a function (urgent ones are components, high ones get their name from a variable) or a call with callbacks; a line
is a call. Parts are aliases of their brand, which stands for a primitive of the framework; suppliers are aliases of the order of
their number, which makes the call graph. What an order or a line is follows from its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import rules
from factloom.operators.analysis import Analysis, Facts, metrics
from factloom.plans.tables import table
from factloom.session import keep, scratch_path
from factloom.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What the brands stand for.
BRANDS = {
    "Brand#1": "createSignal", "Brand#2": "createMemo", "Brand#3": "createEffect", "Brand#4": "createRenderEffect", "Brand#5": "createRoot", "Brand#6": "createStore", "Brand#7": "createTrackedEffect", "Brand#8": "onSettled",
    "Brand#9": "onCleanup", "Brand#10": "flush", "Brand#11": "untrack", "Brand#12": "action", "Brand#13": "runWithOwner", "Brand#14": "createProjection", "Brand#15": "createReaction", "Brand#16": "refresh", "Brand#17": "affects",
    "Brand#18": "mapArray", "Brand#19": "children", "Brand#20": "Loading", "Brand#21": "createSignal", "Brand#22": "createMemo", "Brand#23": "merge",
}

_BASE = """
ord as (select o_orderkey k, '/c' || o_custkey path, o_orderstatus st, o_orderpriority pr, min({day}) * 64 s, max({day}) * 64 + 63 t, min(l_partkey) part, min(l_suppkey) supp
  from {orders} join {lineitem} on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderstatus, o_orderpriority),
lin as (select '/c' || o_custkey path, {day} * 64 + l_linenumber * 4 s, {day} * 64 + l_linenumber * 4 + 2 t, min(l_returnflag) rf, min(l_linestatus) ls, min(l_tax) tax, min(l_partkey) part, min(l_suppkey) supp, min(l_linenumber) n
  from {lineitem} join {orders} on l_orderkey = o_orderkey group by 1, 2, 3),
fn as (select k, path, s, t, case when pr = '1-URGENT' then 'C' || k else 'f' || k end name, pr = '2-HIGH' is_async, st = 'O' exported, st from ord where pr in ('1-URGENT', '2-HIGH')),
co as (select k, path, s, t - 1 t, pr, st, part, supp, (s + t) div_2 mid from ord where pr not in ('1-URGENT', '2-HIGH')),
call0 as (select path, s, t, s cs, s + 1 ce from lin union all select path, s, t, s, s from co),
arg0 as (select path, s, t, 0 pos, s + 1 a_s, mid a_t, case pr when '3-MEDIUM' then 'function' when '5-LOW' then 'identifier' else 'async-function' end v from co
  union all select path, s, t, 1, mid + 1, t - 1, 'function' from co where pr <> '5-LOW' and st <> 'P'),
ent0 as (select path, s, s + 1 t, case rf when 'R' then 's' || supp when 'A' then 'p' || part else case ls when 'O' then 'v' || supp else 'w' || supp end end symbol from lin
  union all select path, s, s, 'p' || part from co union all select path, s, s + 1, 'o' || k from fn union all select path, t - 1, t - 1, 'v' || k from co union all select path, t - 2, t - 2, 'w' || k from co
  union all select path, s + 1, mid, case st when 'F' then 's' when 'O' then 'q' else 'u' end || supp from co where pr = '5-LOW' union all select path, t - 3, t - 3, 'u' || k from co where pr = '5-LOW'
  union all select path, s + 2, s + 2, 'q' || k from fn where st <> 'F'),
sym0 as (select 'p' || p_partkey id, 'b:' || p_brand alias_target, 'part' name, '/src' decl_path from {part} union all select distinct 'b:' || p_brand, cast(null as varchar), {primitive}, '/w/node_modules/solid-js/types.d.ts' from {part}
  union all select 's' || s_suppkey, 'o' || s_suppkey, 'supplier', '/src' from {supplier} union all select 'o' || k, cast(null as varchar), 'order', '/src' from ord
  union all select 'v' || k, cast(null as varchar), 'v', '/src' from co union all select 'w' || k, cast(null as varchar), 'w', '/src' from co),
reg0 as (select path, 'trackedRegions' grp, s, t, 'jsx' label from ord where st = 'P' and pr = '4-NOT SPECIFIED' union all select path, 'callbackRoles', s, t, case when pr = '1-URGENT' then 'directive-apply' else 'event-handler' end from ord where st = 'F' and pr in ('1-URGENT', '2-HIGH')
  union all select path, 'jsxOperations', s, t, 'jsx-expression' from lin where tax >= 0.07),
ret0 as (select path, s, t, case rf when 'R' then 'function' when 'A' then 'identifier' else 'other' end v, case when rf = 'A' and ls = 'O' then '() => void' when rf = 'N' and ls = 'O' then '() => Promise' end ty, s - 200 c_s, t + 200 c_t from lin where tax <= 0.01)
"""


def _case() -> str:
    return "case p_brand " + " ".join(f"when '{b}' then '{p}'" for b, p in BRANDS.items()) + " else p_brand end"


def _base(spark: bool) -> str:
    day = "timestampdiff(DAY, timestamp_ntz'1990-01-01', l_shipdate)" if spark else "date_diff('day', timestamp '1990-01-01', l_shipdate)"
    text = _BASE.replace("(s + t) div_2", "(s + t) div 2" if spark else "(s + t) // 2").replace("{day}", day).replace("{primitive}", _case())
    for name in ("orders", "lineitem", "part", "supplier"):
        text = text if spark else text.replace("{" + name + "}", name)
    return text.replace("varchar", "string") if spark else text


_made: dict[tuple[str, str], Analysis] = {}
_found: dict[tuple[str, str], DataFrame] = {}


def facts(spark: SparkSession, d: str) -> Facts:
    """The base relations, kept as tables. Orders and lines meet once; what is laid out from them reads the result, so no plan holds the join again."""
    tables = {n: table(spark, d, n) for n in ("orders", "lineitem", "part", "supplier")}
    folder = scratch_path(spark, "facts")
    met, laid = _base(True).split("fn as (", 1)
    met = met.strip().rstrip(",")
    for name in ("ord", "lin"):
        tables[name] = keep(spark.sql(f"with {met} select * from {name}", **tables), f"{folder}/{name}")
    laid = "ord as (select * from {ord}), lin as (select * from {lin}),\nfn as (" + laid

    def rel(name: str, select: str) -> DataFrame:
        df = spark.sql(f"with {laid} select {select}", **tables)
        return keep(df.withColumn("project_id", F.lit("trade")), f"{folder}/{name}")

    big = lambda *names: ", ".join(f"cast({n.split()[0]} as bigint) `{n.split()[-1]}`" for n in names)
    return Facts(
        spark,
        calls=rel("calls", f"path, {big('s start', 't end', 'cs callee_start', 'ce callee_end')}, cast(null as string) callee_text from call0"),
        call_args=rel("args", f"path, {big('s call_start', 't call_end')}, pos, {big('a_s start', 'a_t end')}, v value from arg0"),
        functions=rel("functions", f"path, {big('s start', 't end', 's body_start', 't body_end')}, case when not is_async then name end name, {big('s name_start', 's name_end')}, exported, is_async, k ord from fn").withColumns(
            {"name_start": F.when(F.col("name").isNotNull(), F.col("start")), "name_end": F.when(F.col("name").isNotNull(), F.col("start") + 1)}
        ),
        binding_names=rel(
            "bindings",
            f"""path, {big('s init_start', 't init_end')}, name, {big('s start')}, cast(s + 1 as bigint) `end`, cast(null as int) array_slot from fn where is_async
            union all select path, s + 1, mid, 'u' || k, t - 3, t - 3, null from co where pr = '5-LOW' union all select path, s, t, 'v' || k, t - 1, t - 1, 0 from co union all select path, s, t, 'w' || k, t - 2, t - 2, 1 from co""",
        ),
        entities=rel("entities", f"path, {big('s start_byte', 't end_byte')}, symbol, cast(null as string) type_text from ent0"),
        symbols=rel("symbols", "id, alias_target, name, decl_path from sym0"),
        regions=rel("regions", f"path, grp group, {big('s start', 't end')}, label from reg0"),
        returns=rel("returns", f"path, {big('s start', 't end')}, v value, ty type_text, array(struct(cast(c_s as bigint) as start, cast(c_t as bigint) as `end`)) control_tests from ret0"),
        imports=rel("imports", "distinct path, '@trade/' || pr || '/x' module, case st when 'F' then 'known' else 'other' end imported, cast(0 as bigint) start from ord where st <> 'P'"),
        elements=rel("elements", f"path, {big('s start', 't end', 's name_start', 's name_end')} from co"),
        after_await=rel("awaits", f"path, {big('s start', 't end')} from lin where n >= 3"),
        params=rel("params", f"path, {big('s fn_start', 't fn_end')}, 0 pos, case st when 'F' then 'object' else 'name' end shape, cast(case st when 'F' then s else s + 2 end as bigint) start, cast(case st when 'F' then s else s + 2 end as bigint) `end` from fn"),
    )


def analysis(spark: SparkSession, d: str) -> Analysis:
    """The analysis of the session's folder: its relations are tables, made when first asked for and used by all queries until another folder is asked for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        _made.clear()  # the plans of relations stay in the driver as long as they are held here
        _found.clear()
        _made[key] = Analysis(facts(spark, d))
    return _made[key]


_SYMBOLS = "with recursive " + _base(False) + """,
r1 as (select id, id as root, alias_target up, 0 hops from sym0 union all select r1.id, s.id, s.alias_target, hops + 1 from r1 join sym0 s on s.id = r1.up where hops < 50),
roots as (select r.id, arg_max(r.root, r.hops) root, arg_max(case when s.decl_path like '%/node_modules/solid-js/%' then s.name end, r.hops) primitive from (select *, from r1) r join sym0 s on s.id = r.root group by 1),
ent as (select path, s, t, max(symbol) symbol from ent0 where symbol <> '' group by 1, 2, 3),
er as (select path, s, t, coalesce(root, symbol) root, primitive from ent left join roots on id = symbol),
calls as (select c.*, er.root, er.primitive from call0 c left join er on c.path = er.path and c.cs = er.s and c.ce = er.t),
args as (select a.*, c.root, c.primitive from arg0 a join calls c on a.path = c.path and a.s = c.s and a.t = c.t),
nodes as (select f.*, er.root from fn f left join er on f.path = er.path and f.s = er.s and f.s + 1 = er.t),
named as (select root, arg_max(name, k) name from nodes where root is not null group by 1)
"""
_OWNER = """, around as (select c.path, c.s, c.t, arg_min(f.name, (f.t - f.s)::hugeint * 1000000000000 + f.k) owner from (select distinct path, s, t from calls) c join fn f on c.path = f.path and f.s <= c.s and f.t >= c.t group by 1, 2, 3),
edges as (select c.path, c.s, c.t, a.owner src, n.name dst from calls c join named n on c.root = n.root left join around a on c.path = a.path and c.s = a.s and c.t = a.t)
"""
_SOURCES = """, sources as (select er.root, min(case slot when 0 then 'accessor' else 'setter' end) source, min(b.name) name
  from (select path, s, t, t - 1 at_, 0 slot, 'v' || k as name from co union all select path, s, t, t - 2, 1, 'w' || k from co) b
  join (select distinct path, s, t from calls where primitive in ('createSignal', 'createMemo', 'createStore', 'createProjection')) c on b.path = c.path and b.s = c.s and b.t = c.t
  join er on er.path = b.path and er.s = b.at_ and er.t = b.at_ where er.root is not null group by 1)
"""
_ROLES = """, flag as (select p.path, p.s, p.t,
  bool_or(a.pos = 1 and a.primitive in ('createEffect', 'createRenderEffect')) in_apply, bool_or(a.pos = 0 and a.primitive in ('flush', 'untrack', 'onSettled', 'createReaction', 'action')) in_allowed,
  bool_or(a.pos = 0 and a.primitive in ('createMemo', 'createEffect', 'createRenderEffect', 'createTrackedEffect', 'createSignal', 'createStore', 'createProjection')) in_argument
  from (select distinct path, s, t from calls) p join args a on a.path = p.path and a.a_s <= p.s and a.a_t >= p.t group by 1, 2, 3),
reg as (select p.path, p.s, p.t, bool_or(g.grp = 'trackedRegions') in_tracked, arg_min(g.label, g.s::hugeint * 1000000000000 + g.t) filter (g.grp = 'callbackRoles') callback
  from (select distinct path, s, t from calls) p join reg0 g on g.path = p.path and g.s <= p.s and g.t >= p.t and g.s <= g.t group by 1, 2, 3),
roles as (select p.path, p.s, p.t, case when coalesce(in_apply, false) then 'effect-apply' when coalesce(in_allowed, false) then 'deferred' when coalesce(in_tracked, false) or coalesce(in_argument, false) then 'tracked'
  when callback = 'event-handler' then 'event' when callback = 'directive-apply' then 'directive-apply' else 'untracked' end as role
  from (select distinct path, s, t from calls) p left join flag f on p.path = f.path and p.s = f.s and p.t = f.t left join reg r on p.path = r.path and p.s = r.s and p.t = r.t)
"""
_ACCESSES = _SOURCES + _OWNER + _ROLES + """, acc as (select c.path, c.s, c.t, x.source, x.name, a.owner, r.role from calls c join sources x on c.root = x.root left join around a on c.path = a.path and c.s = a.s and c.t = a.t
  left join roles r on c.path = r.path and c.s = r.s and c.t = r.t)
"""
_CALLBACKS = """, inner_fn as (select a.path, a.s, a.t, a.pos, arg_max(f.name, (f.t - f.s)::hugeint * 1000000000000 + f.k) inside from arg0 a join fn f on f.path = a.path and f.s >= a.a_s and f.t <= a.a_t group by 1, 2, 3, 4),
cb as (select a.*, coalesce(i.inside, n.name) target from args a left join inner_fn i on a.path = i.path and a.s = i.s and a.t = i.t and a.pos = i.pos
  left join er e on a.v = 'identifier' and e.path = a.path and e.s = a.a_s and e.t = a.a_t left join named n on n.root = e.root)
"""
_LATTICE = _OWNER + _CALLBACKS + """, own as (select c.*, a.owner, case when pos = 0 and primitive in ('createRoot', 'createMemo', 'createSignal', 'createStore', 'createProjection', 'createEffect', 'createRenderEffect') then 1
    when pos = 1 and primitive in ('createEffect', 'createRenderEffect') then 2 when pos = 0 and primitive in ('createTrackedEffect', 'onSettled') then 4 end sets
  from cb c left join around a on c.path = a.path and c.s = a.s and c.t = a.t where target is not null),
hand as (select arg_max(f.name, (f.t - f.s)::hugeint * 1000000000000 + f.k) node from reg0 g join fn f on f.path = g.path and f.s >= g.s and f.t <= g.t where g.grp = 'callbackRoles' group by g.path, g.s, g.t),
seeds as (select name node, 1 bit from fn where name like 'C%' union select name, 2 from fn where exported and name not like 'C%' union select dst, 2 from edges where src is null
  union select target, sets from own where owner is null and sets is not null union select node, 2 from hand),
steps as (select distinct owner src, target dst, sets from own where owner is not null and sets is not null union select distinct src, dst, null from edges where src is not null),
ctx as (select node, bit from seeds union select s.dst, coalesce(s.sets, c.bit) from ctx c join steps s on s.src = c.node),
contexts as (select node, bit_or(bit)::int context from ctx group by 1)
"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _names(a: Analysis) -> DataFrame:
    return a.nodes.select("node", F.col("name").alias("function"))


@query(_SYMBOLS + "select path, s as start, t as \"end\", root, primitive from calls")
def analysis_calls(spark, d):
    """Calls with the canonical symbol of their callee and the primitive it stands for."""
    return analysis(spark, d).calls.select("path", "start", "end", F.substring_index("callee_root", "\x00", -1).alias("root"), "primitive")


@query(_SYMBOLS + "select name as function, root from nodes")
def analysis_functions(spark, d):
    """Functions with their own name or that of the variable they initialise, and its symbol."""
    return analysis(spark, d).nodes.select(F.col("name").alias("function"), F.substring_index("fn_root", "\x00", -1).alias("root"))


@query(_SYMBOLS + _OWNER + "select path, s as start, t as \"end\", src as caller, dst as callee from edges")
def analysis_call_edges(spark, d):
    """Calls to their functions, from the innermost function around them (null at module level)."""
    a = analysis(spark, d)
    src, dst = _names(a).toDF("src", "caller"), _names(a).toDF("dst", "callee")
    return a.call_edges.join(dst, "dst").join(src, "src", "left").select("path", "start", "end", "caller", "callee")


@query(_SYMBOLS + _ROLES + "select path, s as start, t as \"end\", role from roles")
def analysis_roles(spark, d):
    """The execution role of every call."""
    a = analysis(spark, d)
    return a.placed_calls.select("path", "start", "end", "role")


@query(_SYMBOLS + _SOURCES + "select * from sources")
def analysis_sources(spark, d):
    """Accessors and setters by canonical symbol."""
    return analysis(spark, d).sources.select(F.substring_index("root", "\x00", -1).alias("root"), "source", "name")


@query(_SYMBOLS + """, hop as (select a.root src, b.root dst from co c join er a on a.path = c.path and a.s = c.s + 1 and a.t = c.mid join er b on b.path = c.path and b.s = c.t - 3 and b.t = c.t - 3 where c.pr = '5-LOW'
  union select e.root, b.root from args a join er e on e.path = a.path and e.s = a.a_s and e.t = a.a_t join er b on b.path = a.path and b.s = b.t and b.s in (a.t - 1, a.t - 2) join co c on c.path = a.path and c.s = a.s and c.t = a.t where a.primitive = 'merge'),
pr as (select er.root, min(f.name) component from fn f join er on er.path = f.path and er.s = f.s + 2 and er.t = f.s + 2 where f.name like 'C%' and f.st <> 'F' group by 1),
props as (select root, component from pr union select h.dst, p.component from props p join hop h on h.src = p.root) select root, component from props""")
def analysis_props_roots(spark, d):
    """Symbols that hold a component's props."""
    return analysis(spark, d).props_roots.select(F.substring_index("root", "\x00", -1).alias("root"), "component")


@query(_SYMBOLS + _ACCESSES + "select path, s as start, t as \"end\", source, name, owner, role from acc")
def analysis_accesses(spark, d):
    a = analysis(spark, d)
    return a.accesses.join(_names(a).toDF("owner", "fn"), "owner", "left").select("path", "start", "end", "source", "name", F.col("fn").alias("owner"), "role")


@query(_SYMBOLS + _CALLBACKS + "select path, s as start, t as \"end\", pos, target as function from cb")
def analysis_callbacks(spark, d):
    """Arguments with the function they are: the outermost inside, else the one that an identifier names."""
    a = analysis(spark, d)
    return a.callbacks.join(_names(a).toDF("target", "function"), "target", "left").select("path", F.col("call_start").alias("start"), F.col("call_end").alias("end"), "pos", "function")


@query(_SYMBOLS + _OWNER + _CALLBACKS + """, reach as (select name node from fn where name like 'C%' or exported union select dst from edges where src is null union select target from cb where primitive is not null and target is not null
union select e.dst from reach r join (select distinct src, dst from edges) e on e.src = r.node) select node as function from reach""")
def analysis_reachable(spark, d):
    a = analysis(spark, d)
    return a.reachable.join(_names(a), "node").select("function")


@query(_SYMBOLS + _ACCESSES + """, up as (select distinct src, dst from edges where src is not null), sm as (select owner node, name from acc where source = 'accessor' and owner is not null
union select u.src, sm.name from sm join up u on u.dst = sm.node) select node as function, name from sm""")
def analysis_summaries(spark, d):
    """What each function reads, itself or through what it calls."""
    a = analysis(spark, d)
    return a.summaries.join(_names(a), "node").select("function", "name")


@query(_SYMBOLS + _LATTICE + "select node as function, context from contexts")
def analysis_owner_contexts(spark, d):
    a = analysis(spark, d)
    return a.owner_contexts.join(_names(a), "node").select("function", "context")


@query(_SYMBOLS + """select c.path, c.s as start_byte, c.t as end_byte, c.primitive from calls c join args a on a.path = c.path and a.a_s <= c.s and a.a_t >= c.t
where a.pos = 0 and a.primitive in ('createTrackedEffect', 'onSettled') and (c.primitive in ('onCleanup', 'flush', 'createMemo', 'createEffect', 'createRenderEffect', 'createTrackedEffect', 'createProjection', 'createRoot', 'mapArray', 'children')
or c.primitive in ('createSignal', 'createStore') and exists (select 1 from arg0 x where x.path = c.path and x.s = c.s and x.t = c.t and x.pos = 0 and x.v in ('function', 'async-function')))""")
def analysis_leaf_operations(spark, d):
    """Forbidden operations inside leaf owners, once per owner around them."""
    return analysis(spark, d).leaf_operations.select("path", "start_byte", "end_byte", "primitive")


@query(_SYMBOLS + """select distinct r.path, r.s as start_byte, r.t as end_byte, a.primitive as subject,
case when r.v = 'function' or coalesce(r.ty = '() => void', false) then 'sound' when r.v = 'identifier' and r.ty is null then 'unresolved' else 'invalid' end status
from ret0 r join args a on a.path = r.path and a.a_s <= r.s and a.a_t >= r.t where a.pos = 0 and a.primitive in ('onSettled', 'createTrackedEffect', 'createReaction') or a.pos = 1 and a.primitive in ('createEffect', 'createRenderEffect')""")
def analysis_cleanup_returns(spark, d):
    return analysis(spark, d).cleanup_returns.select("path", "start_byte", "end_byte", "subject", "status")


@query(_SYMBOLS + _ACCESSES + """select distinct r.path, r.s as start_byte, r.t as end_byte from ret0 r join acc c on c.path = r.path and c.source = 'accessor' and r.c_s <= c.s and r.c_t >= c.t
where (select arg_min(f.name, (f.t - f.s)::hugeint * 1000000000000 + f.k) from fn f where f.path = r.path and f.s <= r.s and f.t >= r.t) like 'C%'""")
def analysis_conditional_returns(spark, d):
    """Returns of components whose test reads a source."""
    return analysis(spark, d).conditional_returns.select("path", "start_byte", "end_byte").distinct()


@query(_SYMBOLS + _OWNER + """, dir as (select arg_max(f.name, (f.t - f.s)::hugeint * 1000000000000 + f.k) node from reg0 g join fn f on f.path = g.path and f.s >= g.s and f.t <= g.t where g.label = 'directive-apply' group by g.path, g.s, g.t),
deep as (select node from dir union select e.dst from deep d join (select distinct src, dst from edges) e on e.src = d.node)
select c.path, c.s as start_byte, c.t as end_byte, c.primitive from calls c join around a on c.path = a.path and c.s = a.s and c.t = a.t join deep d on d.node = a.owner
where c.primitive in ('createSignal', 'createMemo', 'createStore', 'createEffect', 'createRenderEffect', 'createTrackedEffect', 'createProjection', 'createRoot', 'mapArray', 'children')""")
def analysis_directive_creations(spark, d):
    return analysis(spark, d).directive_creations.select("path", "start_byte", "end_byte", "primitive")


@query(_SYMBOLS + """, shape as (select path, s, t, primitive, max(pos) last_, max(case when pos = 0 then v end) first_ from args group by 1, 2, 3, 4)
select path, s as start_byte, t as end_byte, 'missing-effect-function' as rule, primitive as subject from shape where primitive in ('createEffect', 'createRenderEffect') and last_ < 1""")
def analysis_static_api(spark, d):
    return analysis(spark, d).static_api.select("path", "start_byte", "end_byte", "rule", "subject")


@query(_SYMBOLS + """select g.path, g.s as start_byte, g.t as end_byte from reg0 g where g.grp = 'jsxOperations' and not exists (select 1 from reg0 k where k.path = g.path and k.s <= g.s and k.t >= g.t and k.grp in ('trackedRegions', 'callbackRoles'))""")
def analysis_uncovered_markup(spark, d):
    return analysis(spark, d).uncovered_markup.select("path", "start_byte", "end_byte")


@query(_SYMBOLS + """, imp as (select distinct path, '@trade/' || pr m, case st when 'F' then 'known' else 'other' end imported from ord where st <> 'P'),
lost as (select m || '/x' subject, 'package-contract-missing' as rule, min(path) path from imp where m <> '@trade/5-LOW' group by 1)
select path, rule, subject from lost union all select path, 'package-contract-export-missing', imported from imp where m = '@trade/5-LOW' and imported <> 'known'""")
def analysis_contract_violations(spark, d):
    """Imports without a contract, and names that the contract of their package does not export."""
    exports = spark.createDataFrame([("@trade/5-LOW", "known")], "name string, export string")
    return analysis(spark, d).contract_violations(exports).select("path", "rule", "subject")


@query(_SYMBOLS + _LATTICE + """, loading as (select distinct c.path, c.s, c.t from co c join er on er.path = c.path and er.s = c.s and er.t = c.s where er.primitive = 'Loading'),
settled as (select distinct a.path, a.s, a.t from args a join ret0 r on r.path = a.path and a.a_s <= r.s and a.a_t >= r.t and r.v = 'function' where a.pos = 0 and a.primitive = 'onSettled'),
ops as (select path, s, t, case when primitive = 'onCleanup' then 'cleanup' else 'effect' end operation from calls where primitive in ('createEffect', 'createRenderEffect', 'createTrackedEffect', 'onCleanup')
  union all select path, s, t, 'boundary' from loading union all select path, s, t, 'settled-cleanup' from settled),
free as (select * from ops o where not exists (select 1 from args a where a.path = o.path and a.a_s <= o.s and a.a_t >= o.t and (a.pos = 0 and a.primitive in ('createRoot', 'createMemo', 'createEffect', 'createRenderEffect', 'createProjection', 'createSignal', 'createStore') or a.pos = 1 and a.primitive = 'runWithOwner'))),
held as (select o.*, f.name as owner, f.exported from free o left join lateral (select f.name, f.exported from fn f where f.path = o.path and f.s <= o.s and f.t >= o.t order by f.t - f.s, f.k limit 1) f on true)
select h.path, h.s as start_byte, h.t as end_byte, operation, (case when owner is null then 2 else coalesce(context, 0) end & case when operation in ('effect', 'boundary') then 2 else 6 end) <> 0 report,
coalesce(exported and owner not like 'C%', false) and (case when owner is null then 2 else coalesce(context, 0) end & 2) <> 0 as uncertain from held h left join contexts c on c.node = h.owner""")
def analysis_missing_owners(spark, d):
    return analysis(spark, d).missing_owners.select("path", "start_byte", "end_byte", "operation", "report", "uncertain")


_IN_LOWER = "exists (select 1 from fn f where f.name like 'f%' and f.path = x.path and f.s <= x.s and f.t >= x.t)"
_IN_UPPER = "exists (select 1 from fn f where f.name like 'C%' and f.path = x.path and f.s <= x.s and f.t >= x.t)"


def _of(name: str) -> str:
    """The select of a registered relation, for use inside a larger statement: all share their first parts."""
    return SQL[name][len(_SYMBOLS) :]


_FOUND = (
    _SYMBOLS + _ACCESSES + _LATTICE[len(_OWNER) :] + """, up as (select distinct src, dst from edges where src is not null),
sm as (select owner node, name from acc where source = 'accessor' and owner is not null union select u.src, sm.name from sm join up u on u.dst = sm.node),
through as (select x.path, x.s, x.t, min(sm.name) as name from edges x join sm on sm.node = x.dst group by 1, 2, 3),
reads as (select path, s, t, role, name from acc x where source = 'accessor' and not """ + _IN_LOWER + """
  union all select x.path, x.s, x.t, r.role, x.name from through x left join roles r on r.path = x.path and r.s = x.s and r.t = x.t where """ + _IN_UPPER + """),
late_roots as (select distinct er.root from co b join args a on a.path = b.path and a.s = b.s and a.t = b.t and a.pos = 0 and a.v = 'async-function' and a.primitive in ('createSignal', 'createMemo', 'createStore', 'createProjection')
  join er on er.path = b.path and er.s = b.t - 1 and er.t = b.t - 1),
loading0 as (select distinct c.path, c.s, c.t from co c join er on er.path = c.path and er.s = c.s and er.t = c.s where er.primitive = 'Loading'),
late as (select c.path, c.s, c.t, r.role, exists (select 1 from args a where a.path = c.path and a.a_s <= c.s and a.a_t >= c.t and a.pos = 0 and a.primitive in ('createTrackedEffect', 'onSettled')) leaf,
  exists (select 1 from loading0 l where l.path = c.path and l.s <= c.s and l.t >= c.t) shown from calls c join late_roots using (root) left join roles r on r.path = c.path and r.s = c.s and r.t = c.t),
targets as (select a.path, a.s, a.t, a.primitive, e.root, x.root is not null is_source from args a left join er e on e.path = a.path and e.s = a.a_s and e.t = a.a_t left join sources x on x.root = e.root where a.pos = 0 and a.primitive in ('refresh', 'affects')),
hits as (select path, s, t, 'strict-read-untracked' as rule, name subject, false uncertain from reads where role in ('untracked', 'effect-apply')
union all select path, s, t, 'reactive-write-in-owned-scope', name, false from acc where source = 'setter' and role not in ('event', 'deferred', 'effect-apply', 'directive-apply')
union all select path, s, t, case when leaf then 'pending-async-forbidden-scope' when role = 'untracked' then 'pending-async-untracked-read' when role = 'tracked' and not shown then 'async-outside-loading-boundary' end, null, false from late
union all select path, start_byte, end_byte, case primitive when 'onCleanup' then 'cleanup-in-forbidden-scope' when 'flush' then 'flush-in-forbidden-scope' else 'primitive-in-leaf-owner' end, primitive, false from (""" + _of("analysis_leaf_operations") + """)
union all select path, start_byte, end_byte, case status when 'invalid' then 'invalid-cleanup-return' when 'unresolved' then 'cleanup-return-unresolved' end, subject, false from (""" + _of("analysis_cleanup_returns") + """)
union all select path, start_byte, end_byte, case operation when 'cleanup' then 'no-owner-cleanup' when 'boundary' then 'no-owner-boundary' when 'settled-cleanup' then 'settled-cleanup-unowned' else 'no-owner-effect' end, operation, uncertain
  from (""" + "with " + _of("analysis_missing_owners")[len(_LATTICE) :].lstrip(", ") + """) where report
union all select path, start_byte, end_byte, 'primitive-in-directive-application', primitive, false from (""" + "with recursive " + _of("analysis_directive_creations")[len(_OWNER) :].lstrip(", ") + """)
union all select path, start_byte, end_byte, rule, subject, false from (""" + "with " + _of("analysis_static_api").lstrip(", ") + """)
union all select path, start_byte, end_byte, 'component-returns-conditionally', '', false from (""" + _of("analysis_conditional_returns")[len(_ACCESSES) :] + """)
union all select path, start_byte, end_byte, 'execution-map-incomplete', '', false from (""" + _of("analysis_uncovered_markup") + """)
union all select path, s, t, case when root is null then primitive || '-target-unresolved' else 'invalid-' || primitive || '-target' end, primitive, false from targets where root is null or not is_source
union all select x.path, x.s, x.t, 'reactive-read-after-await', x.name, false from acc x where x.source = 'accessor' and exists (select 1 from lin l where l.path = x.path and l.s = x.s and l.t = x.t and l.n >= 3)
union all select path, s, s, 'component-props-destructure', name, false from fn where name like 'C%' and st = 'F'
union all select path, 0, 0, rule, subject, false from (""" + "with " + _of("analysis_contract_violations").lstrip(", ") + """)),
catalogue as (select * from (values
('SC1001', 'strict-read-untracked', 'warning'), ('SC1002', 'reactive-read-after-await', 'error'), ('SC1003', 'component-props-destructure', 'error'), ('SC1004', 'component-returns-conditionally', 'error'), ('SC2001', 'reactive-write-in-owned-scope', 'error'),
('SC3001', 'cleanup-in-forbidden-scope', 'error'), ('SC3002', 'primitive-in-leaf-owner', 'error'), ('SC3003', 'flush-in-forbidden-scope', 'error'), ('SC3004', 'invalid-cleanup-return', 'error'), ('SC3005', 'settled-cleanup-unowned', 'error'),
('SC4001', 'no-owner-effect', 'warning'), ('SC4002', 'no-owner-cleanup', 'warning'), ('SC4003', 'no-owner-boundary', 'warning'), ('SC5001', 'pending-async-untracked-read', 'error'), ('SC5002', 'pending-async-forbidden-scope', 'warning'),
('SC5003', 'async-outside-loading-boundary', 'warning'), ('SC6001', 'primitive-in-directive-application', 'error'), ('SC7001', 'missing-effect-function', 'error'), ('SC7003', 'invalid-refresh-target', 'error'), ('SC7003', 'invalid-affects-target', 'error'),
('SC9001', 'package-contract-export-missing', 'error'), ('SC9002', 'cleanup-return-unresolved', 'error'), ('SC9003', 'refresh-target-unresolved', 'error'), ('SC9003', 'affects-target-unresolved', 'error'), ('SC9004', 'execution-map-incomplete', 'error'),
('SC9005', 'package-contract-missing', 'error')) v(code, rule, severity)),
found as (select distinct 'trade' project_id, path, s::bigint start_byte, t::bigint end_byte, code, rule, case when uncertain or code like 'SC9%' then 'uncertifiable' else 'violation' end kind, case when uncertain then 'error' else severity end severity, subject from hits join catalogue using (rule))
"""
)


@query(_FOUND + "select * from found")
def analysis_findings(spark, d):
    """All nine streams through all rules."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _found:
        exports = spark.createDataFrame([("@trade/5-LOW", "known")], "name string, export string")
        found = analysis(spark, d).findings(exports)
        _found[key] = keep(found, scratch_path(spark, "findings"))
    return _found[key]


@query(_FOUND + """select project_id, case when bool_or(kind = 'violation') then 'violation' when bool_or(kind = 'uncertifiable') then 'uncertifiable' else 'certified' end status,
count(*) filter (severity = 'error') n_errors, count(*) filter (severity = 'warning') n_warnings from found group by 1""")
def analysis_status(spark, d):
    return rules.status(analysis_findings(spark, d), ["project_id"])


@query(_FOUND + "select project_id, count(*) n_obligations from (select distinct project_id, rule, path, start_byte, end_byte from found) group by 1")
def finding_metrics(spark, d):
    return rules.obligations(analysis_findings(spark, d))


@query(_FOUND + "select path || ':' || start_byte || ': ' || severity || ' ' || code || ' ' || rule as line from found")
def text_report(spark, d):
    return sinks.text_report(analysis_findings(spark, d))


@query(_FOUND + "select json_object('kind', kind, 'code', code, 'rule', rule, 'severity', severity, 'project_id', project_id, 'path', path, 'start_byte', start_byte, 'end_byte', end_byte)::varchar as json from found")
def snapshot_json(spark, d):
    return sinks.snapshot_json(analysis_findings(spark, d))


@query()
def analysis_metrics(spark, d):
    """Counts of files, functions, summaries, obligations and streams; contracts are left out, so the findings are the streams' own."""
    a = analysis(spark, d)
    return metrics(a, keep(a.findings(), scratch_path(spark, "own-findings")))
