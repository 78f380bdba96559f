"""Functions, orders, set tests and sessions over whole tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import paths, text
from factloom.operators import analysis, fixpoint, ordering, retained, rules, tables
from factloom.plans import engine, program
from factloom.plans.records import _PLAIN
from factloom.plans.tables import table
from factloom.session import scratch_path
from factloom.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_NAMES = """n as (select distinct d.name as name, d."location".path path from (select unnest(declarations) d from symbols) where d.name is not null)"""


@query(f"with {_NAMES} select name, path, regexp_matches(name, '^\\p{{Lu}}') component, string_split(name || '.' || path, '.')[-1] segment, 'file://' || replace(url_encode(path), '%2F', '/') uri, path again, 'https://docs/rules/' || name || '.md' page from n")
def declared_names(spark, d):
    """Names of declarations: component or not, the last segment of a dotted callee, the file's URI and the path read from it again, the page of a rule of that name."""
    n = table(spark, d, "symbols").select(F.explode("declarations").alias("x")).select("x.name", "x.location.path").where("name is not null").distinct()
    uri = text.path_uri(F.col("path"))
    dotted = F.concat("name", F.lit("."), "path")
    return n.select("name", "path", text.component_name(F.col("name")).alias("component"), text.last_segment(dotted).alias("segment"), uri.alias("uri"), text.uri_path(uri).alias("again"), text.docs_url("https://docs/rules", F.col("name")).alias("page"))


@query("""select distinct row_id, regexp_matches(type_text, '\\b(Promise|PromiseLike|AsyncIterable)\\b') is_async,
trim(return_type_text) in ('void', 'undefined', 'never', 'VoidFunction') or (contains(return_type_text, '=>') and not regexp_matches(return_type_text, 'Promise|AsyncIterable|number|string|boolean|null|\\{')) gives_cleanup from entities""")
def type_texts(spark, d):
    """Asynchronous types, and result types that are cleanups."""
    return table(spark, d, "entities").select("row_id", text.async_type(F.col("type_text")).alias("is_async"), text.cleanup_type(F.col("return_type_text")).alias("gives_cleanup")).distinct()


_SPANS = f"""s as (select project_id, {_PLAIN.format('path')} path, max(octet_length(encode(source))) size from source_files where source is not null and project_id is not null and path is not null group by 1, 2),
e as (select distinct row_id, project_id, {_PLAIN.format('path')} path, start_byte, end_byte from entities)"""


@query(f"with {_SPANS} select e.row_id, start_byte >= 0 and start_byte <= end_byte and end_byte <= size valid, start_byte <= size // 2 and end_byte >= size // 2 holds_middle from e join s on e.project_id = s.project_id and e.path = s.path")
def span_tests(spark, d):
    """Spans of entities against the texts of their files: within the text, and around its middle."""
    s = table(spark, d, "source_files").where("source is not null and project_id is not null and path is not null")
    s = s.groupBy("project_id", paths.plain_path(F.col("path")).alias("path")).agg(F.max_by("source", F.octet_length("source")).alias("source"))
    e = table(spark, d, "entities").select("row_id", "project_id", paths.plain_path(F.col("path")).alias("path"), "start_byte", "end_byte").distinct()
    middle = F.floor(F.octet_length("source") / 2)
    return e.join(s, ["project_id", "path"]).select("row_id", text.span_valid(F.col("start_byte"), F.col("end_byte"), F.col("source")).alias("valid"), text.span_contains(F.col("start_byte"), F.col("end_byte"), middle, middle).alias("holds_middle"))


@query("select doc_id, strpos(reverse(source || '.' || title), '.') - 1 tail_chars from documents where source is not null and title is not null")
def callee_properties(spark, d):
    """Callees made of a source and a title: how many characters stand after the last dot, from byte offsets."""
    t = table(spark, d, "documents").where("source is not null and title is not null").select("doc_id", F.concat("source", F.lit("."), "title").alias("callee"))
    whole = F.concat(F.lit("é("), "callee", F.lit(")"))
    start, end = F.lit(3), F.octet_length("callee") + 3
    return t.select("doc_id", F.length(text.byte_slice(whole, text.property_start(whole, start, end), end)).alias("tail_chars"))


@query("""select doc_id, least(n, m) pairs from (select doc_id, length(coalesce(text, '')) n, length(coalesce(text, '')) // 2 m from (select doc_id, left(title, 5) as text from documents where title is not null))""")
def parentheses(spark, d):
    """Pairs of parentheses around a name in texts that are given as many opening ones as the title has letters, up to five, and half as many closing ones."""
    t = table(spark, d, "documents").where("title is not null").select("doc_id", F.least(F.length("title"), F.lit(5)).alias("n"))
    made = F.concat(F.lit("é + "), F.expr("repeat('( ', n)"), F.lit("x"), F.expr("repeat(' )', n div 2)"), F.lit(";"))
    start = (F.col("n") * 2 + 5).cast("int")
    return t.select("doc_id", text.parentheses_around(made, start, start + 1).cast("bigint").alias("pairs"))


@query("""with e as (select distinct row_id, project_id, path, start_byte, end_byte from entities where path is not null)
select row_id, project_id, path, row_number() over (partition by project_id, path order by start_byte nulls first, end_byte nulls first, row_id) - 1 as position from e""")
def stream_order(spark, d):
    """The order of a stream by location, as positions in each file."""
    e = table(spark, d, "entities").where("path is not null").select("row_id", "project_id", "path", "start_byte", "end_byte").distinct()
    return ordering.positions(e, ["project_id", "path"], ["start_byte", "end_byte", "row_id"], 1024).select("row_id", "project_id", "path", "position")


@query("""with e as (select distinct project_id, path, start_byte, end_byte from entities where path is not null)
select *, row_number() over (partition by project_id, path order by start_byte nulls first, end_byte nulls first) - 1 as position from e""")
def demand_order(spark, d):
    """Demands for locations, each once, in order."""
    return ordering.demands(table(spark, d, "entities").where("path is not null"), ["project_id", "path"], ["start_byte", "end_byte"], 1024)


@query("""with s as (select distinct project_id, row_id, case d.kind when 'import' then 0 when 'parameter' then 2 else 1 end phase, d."location".path path, d."location".start_byte start_byte from
(select project_id, row_id, declarations[1] d from symbols) where d."location".path is not null)
select project_id, row_id, row_number() over (partition by project_id order by phase, path, start_byte nulls first, row_id) - 1 as position from s""")
def source_order(spark, d):
    """Sources in order of phase, then of the place of their declaration."""
    first = F.try_element_at("declarations", F.lit(1))
    s = table(spark, d, "symbols").select("project_id", "row_id", first.alias("x")).where("x.location.path is not null")
    phase = F.when(F.col("x.kind") == "import", 0).when(F.col("x.kind") == "parameter", 2).otherwise(1)
    s = s.select("project_id", "row_id", phase.alias("phase"), F.col("x.location.path").alias("path"), F.col("x.location.start_byte").alias("start_byte")).distinct()
    return ordering.positions(s, ["project_id"], ["phase", "path", "start_byte", "row_id"], 1).select("project_id", "row_id", "position")


@query("""with f as (select project_id, symbol, path, min(start_byte) start_byte from entities where symbol <> '' and path is not null and start_byte is not null group by 1, 2, 3)
select project_id, symbol, arg_min(path, row(path, start_byte)) path, arg_min(start_byte, row(path, start_byte)) start_byte, count(*) n_given from f group by 1, 2""")
def source_contributions(spark, d):
    """What each file contributes to a symbol, merged in order of files."""
    e = table(spark, d, "entities").where("symbol <> '' and path is not null and start_byte is not null")
    per_file = e.groupBy("project_id", "symbol", "path").agg(F.min("start_byte").alias("start_byte"))
    return ordering.merged_contributions(per_file, ["project_id", "symbol"], ["path", "start_byte"])


@query(f"with b as ({engine._NEW}) select *, row_number() over (order by o_orderkey) - 1 as position from b")
def ordered_insert(spark, d):
    """A delta put into a retained table, and the positions of all rows after it."""
    old, new = engine._generations(spark, d)
    put = tables.keyed_apply(old, tables.keyed_diff(old, new, ["o_orderkey"]), ["o_orderkey"])
    return ordering.positions(put.withColumn("_one", F.lit(1)), ["_one"], ["o_orderkey"], 1000).drop("_one")


@query(f"""with a as ({engine._OLD}), b as ({engine._NEW}) select (select count(*) from (select * from a except select * from b)) = 0 and (select count(*) from (select * from b except select * from a)) = 0 same,
(select count(*) from (select * from a intersect select * from b)) = 0 apart, (select count(*) from (select * from b except select * from a)) > 0 grew, false changed_nothing""")
def set_tests(spark, d):
    """Equality, disjointness, growth and emptiness of a difference, for two generations."""
    old, new = engine._generations(spark, d)
    said = (tables.set_equal(old, new), tables.disjoint(old, new), tables.grow(old, new)[1], tables.is_empty(tables.keyed_diff(old, new, ["o_orderkey"])))
    return spark.createDataFrame([said], "same boolean, apart boolean, grew boolean, changed_nothing boolean")


@query(f"""with a as (select *, o_orderkey % 50 path from ({engine._OLD})), b as (select *, o_orderkey % 50 path from ({engine._NEW})) select * from a where path >= 40 union all select * from b where path < 40""")
def index_patch(spark, d):
    """An index patched with what the affected files give anew."""
    old, new = (x.withColumn("path", F.col("o_orderkey") % 50) for x in engine._generations(spark, d))
    return retained.patch(old, new, spark.range(40).select(F.col("id").alias("path")))


@query(f"""with a as (select o_orderkey, o_orderstatus, o_orderkey // 10 path from ({engine._OLD})), b as (select o_orderkey, o_orderstatus, o_orderkey // 10 path from ({engine._NEW})),
x as (select path, list_sort(list(row(o_orderkey, o_orderstatus))) v from a group by 1), y as (select path, list_sort(list(row(o_orderkey, o_orderstatus))) v from b group by 1)
select path from x full join y using (path) where x.v is distinct from y.v""")
def shape_cutoff(spark, d):
    """Of all files those whose exports changed their shape."""
    old, new = (x.select((F.col("o_orderkey").cast("bigint") - F.col("o_orderkey") % 10).alias("tens"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("kind")).select((F.col("tens") / 10).cast("bigint").alias("path"), "name", "kind") for x in engine._generations(spark, d))
    return retained.reshaped(old, new, old.select("path").union(new.select("path")).distinct())


@query(f"select o_orderstatus, count(*) n, 2 asked from ({engine._NEW}) group by 1")
def cached_answers(spark, d):
    """An aggregate asked for twice and computed once."""
    _, new = engine._generations(spark, d)
    cache = retained.AnswerCache(scratch_path(spark, "answers"))
    count = lambda x: x.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    known = [cache.answer([new], count)[1] for _ in range(2)]
    answer, _ = cache.answer([new], count)
    return answer.withColumn("asked", F.lit(2 if known == [False, True] else 0))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'HOUSEHOLD')")
def demanded_facts(spark, d):
    """Only the facts of what is asked for."""
    asked = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return readers.demanded(table(spark, d, "orders"), asked, ["o_custkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""with s as (select project_id, {_PLAIN.format('path')} path, generation, 'sha256:' || regexp_replace(lower(trim(sha256)), '^sha256:', '') h from sources),
f as (select distinct file_id, project_id, {_PLAIN.format('path')} path, generation, 'sha256:' || sha256(source) actual from source_files where path is not null)
select distinct f.file_id, f.path, s.h is not distinct from f.actual agrees from f join s on f.project_id = s.project_id and f.path = s.path and f.generation = s.generation""")
def artifact_hashes(spark, d):
    """Files whose text has the digest that was delivered for it."""
    digest = F.concat(F.lit("sha256:"), F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", ""))
    s = table(spark, d, "sources").select("project_id", paths.plain_path(F.col("path")).alias("path"), "generation", digest.alias("sha256"))
    f = table(spark, d, "source_files").where("path is not null").select("file_id", "project_id", paths.plain_path(F.col("path")).alias("path"), "generation", "source").distinct()
    return readers.hashed_sources(f.join(s, ["project_id", "path", "generation"])).select("file_id", "path", "agrees").distinct()


@query(program._SYMBOLS + program._ROLES + """select path, s as start, t as \"end\", case role when 'tracked' then 'tracked' when 'deferred' then 'deferred' else 'inline' end execution,
case when role = 'deferred' and exists (select 1 from reg0 g where g.grp = 'jsxOperations' and g.path = r.path and g.s <= r.s and g.t >= r.t) then 'tracked' else role end async_role from roles r""".replace('\\"', '"'))
def execution_names(spark, d):
    """What contracts call the role of each call, and the role that pending reads have there."""
    a = program.analysis(spark, d)
    markup = a.f.regions.where("group = 'jsxOperations'").select("project_id", "path", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    calls = a.placed_calls.select("project_id", "path", "start", "end", "role")
    inside = analysis._inside(analysis._points(calls, "start", "end", ["start", "end"]), markup).select("project_id", "path", "start", "end", F.lit(True).alias("in_markup")).distinct()
    placed = calls.join(inside, ["project_id", "path", "start", "end"], "left")
    role = rules.async_role(F.col("role"), F.coalesce("in_markup", F.lit(False)))
    return placed.select("path", "start", "end", rules.execution_name(F.col("role")).alias("execution"), role.alias("async_role"))


@query(program._SYMBOLS + program._ACCESSES + """select path, s as start, role || ' in ' || coalesce(owner, 'module') as label from acc""")
def context_labels(spark, d):
    """Where each access stands, in words."""
    a = program.analysis(spark, d)
    named = a.accesses.join(a.nodes.select(F.col("node").alias("owner"), F.col("name").alias("fn")), "owner", "left")
    return named.select("path", "start", analysis.context_label(F.col("role"), F.col("fn")).alias("label"))


@query("""select distinct project_id, symbol || '::' || p id, p as primitive from entities, (values ('createSignal'), ('createMemo'), ('dynamic')) v(p) where symbol <> ''""")
def namespace_names(spark, d):
    """Names of primitives that every symbol would have as a namespace."""
    return analysis.namespace_members(table(spark, d, "entities").where("symbol <> ''").select("project_id", "symbol").distinct(), ["createSignal", "createMemo", "dynamic"])


@query(program._FOUND + "select true fails, n_errors from (select project_id, count(*) filter (severity = 'error') n_errors from found group by 1)")
def exit_rule(spark, d):
    """Whether a run that must certify fails."""
    return sinks.failing_exit(program.analysis_status(spark, d), True).select("fails", "n_errors")


@query("""with recursive e as (select distinct project_id || ':' || id src, project_id || ':' || alias_target dst from symbols where alias_target <> ''),
t as (select distinct project_id || ':' || coalesce(nullif(call_target, ''), symbol) node, case when call_target <> '' then 'full' else 'light' end tier from entities where coalesce(nullif(call_target, ''), symbol) <> ''
  union select e.dst, t.tier from t join e on e.src = t.node) select node, min(tier) tier from t group by 1""")
def demand_closure(spark, d):
    """Symbols that must be described since an entity, or an alias that leads to them, asks for them, and which of them in full."""
    full = lambda c: F.concat(F.col("project_id"), F.lit(":"), c)
    edges = table(spark, d, "symbols").where("alias_target <> ''").select(full(F.col("id")).alias("src"), full(F.col("alias_target")).alias("dst"))
    asked = F.coalesce(F.nullif("call_target", F.lit("")), "symbol")
    tier = F.when(F.col("call_target") != "", "full").otherwise("light")
    seeds = table(spark, d, "entities").where(asked != "").select(full(asked).alias("node"), tier.alias("tag")).distinct()
    return fixpoint.spread(seeds, edges).groupBy("node").agg(F.min("tag").alias("tier"))


@query(engine._ROOTS + "select e.row_id node, t.root from e left join t using (row_id) where e.parent is not null and (e.project_id, e.id) in (select project_id, symbol from entities where type_text like 'Promise%')")
def async_roots(spark, d):
    """Canonical symbols of the aliases that stand for asynchronous values."""
    current, edges = engine._aliases(spark, d)
    late = table(spark, d, "entities").where("type_text like 'Promise%'").select("project_id", F.col("symbol").alias("id")).distinct()
    return fixpoint.roots_by_doubling(edges).join(current.join(late, ["project_id", "id"], "left_semi").select("node"), "node", "left_semi").select("node", "root")


_LINES = """l as (select file_id, unnest(string_split(source, chr(10))) line from (select distinct file_id, source from source_files where source is not null)),
v as (select distinct file_id, line, regexp_extract(line, '=\\s(.*)$', 1) as value from l where contains(line, '=>'))"""


@query(f"with {_LINES} select file_id, line, regexp_matches(value, '^\\s*(async\\s*)?(\\([^)]*\\)|[A-Za-z0-9_$]+)\\s*=>') arrow, regexp_matches(line, '^(export )?const\\s*\\[\\s*\\w+[^=]*\\]\\s*=\\s*\\w+(<[^>]*>)?\\(') pair from v")
def binding_patterns(spark, d):
    """Lines that assign arrow functions, and those that take a call's result apart into an array."""
    f = table(spark, d, "source_files").where("source is not null").select("file_id", "source").distinct()
    lines = f.select("file_id", F.explode(F.split("source", "\n")).alias("line")).where("contains(line, '=>')").distinct()
    value = F.regexp_extract("line", r"=\s(.*)$", 1)
    name = F.regexp_extract("line", r"^((?:export )?const\s*\[\s*)(\w+)([^=]*\]\s*=\s*)(\w+)(.*)$", 1), F.regexp_extract("line", r"^((?:export )?const\s*\[\s*)(\w+)([^=]*\]\s*=\s*)(\w+)(.*)$", 3), F.regexp_extract("line", r"^((?:export )?const\s*\[\s*)(\w+)([^=]*\]\s*=\s*)(\w+)(.*)$", 5)
    return lines.select("file_id", "line", text.returned_arrow(value).alias("arrow"), text.constant_array_binding(*name).alias("pair"))


@query(program._FOUND + """select project_id, path, start_byte, code, rule, subject, row_number() over (partition by project_id, path order by start_byte, code, rule, subject nulls first, end_byte, kind) - 1 as position from found""")
def findings_order(spark, d):
    """The order of findings, as positions in each file."""
    order = ["start_byte", "code", "rule", "subject", "end_byte", "kind"]
    return ordering.positions(program.analysis_findings(spark, d), ["project_id", "path"], order, 1024).select("project_id", "path", "start_byte", "code", "rule", "subject", "position")


@query(engine.SQL["finding_lines"].replace("select project_id, path, b as start_byte", "select project_id, path, b as start_byte, source", 1).join(["with q as (", """) select project_id, path, start_byte, line_no,
left(rtrim(replace(string_split(source, chr(10))[line_no], chr(13), ''), ' '), 80) excerpt from q where source is not null"""]))
def finding_excerpts(spark, d):
    """The line of text that each finding stands in; findings in unknown files have none."""
    s = table(spark, d, "source_files").where("source is not null and project_id is not null and path is not null")
    s = s.groupBy("project_id", paths.plain_path(F.col("path")).alias("path")).agg(F.min_by("source", "file_id").alias("source"))
    f = table(spark, d, "findings").where("project_id is not null and primary_location.path is not null and primary_location.start_byte is not null")
    f = f.select("project_id", paths.plain_path(F.col("primary_location.path")).alias("path"), F.col("primary_location.start_byte").alias("start_byte"), F.lit("").alias("rule")).distinct()
    return sinks.excerpts(f, s).select("project_id", "path", "start_byte", "line_no", "excerpt")
