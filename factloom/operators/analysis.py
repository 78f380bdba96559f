"""Whole-program analysis over fact tables.

Facts are DataFrames keyed by project_id and path, spans are byte offsets. Every step is a
relation made from earlier ones: canonical symbols, primitives of calls, enclosing
functions, execution roles, reactive sources, reads and writes, ownership, reachability and
summaries. :func:`streams` gives the inputs of the rule catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import contracts, fixpoint, rules, spans
from factloom.session import keep, scratch_path

FILE = ["project_id", "path"]

#: Width of the slots for containment joins, in bytes.
SLOT = 2048

#: What marks a declaration of the framework, and the primitives it may declare.
FRAMEWORK = "/node_modules/solid-js/"
OWNED_ARGUMENT_0 = ["createRoot", "createMemo", "createSignal", "createStore", "createProjection", "createOptimistic", "createOptimisticStore", "createEffect", "createRenderEffect"]
UNOWNED_ARGUMENT_1 = ["createEffect", "createRenderEffect"]
LEAF_ARGUMENT_0 = ["createTrackedEffect", "onSettled"]
PROVIDING_0 = ["createRoot", "createMemo", "createEffect", "createRenderEffect", "createProjection", "createSignal", "createStore"]
TRACKED_ARGUMENT_0 = ["createMemo", "createEffect", "createRenderEffect", "createTrackedEffect", "createSignal", "createStore", "createProjection", "createOptimistic", "createOptimisticStore", "dynamic"]
ALLOWED_ARGUMENT_0 = ["flush", "untrack", "onSettled", "createReaction", "action"]
SOURCES = ["createSignal", "createMemo", "createStore", "createProjection", "createOptimistic", "createOptimisticStore"]
LEAF_FORBIDDEN = ["onCleanup", "flush", "createMemo", "createEffect", "createRenderEffect", "createTrackedEffect", "createProjection", "createRoot", "createOwner", "mapArray", "children"]
LEAF_FORBIDDEN_WITH_FUNCTION = ["createSignal", "createStore", "createOptimistic", "createOptimisticStore"]
CLEANUP_RETURN_0 = ["onSettled", "createTrackedEffect", "createReaction"]
DIRECTIVE_CREATED = ["createSignal", "createMemo", "createStore", "createEffect", "createRenderEffect", "createTrackedEffect", "createProjection", "createOptimistic", "createOptimisticStore", "createRoot", "mapArray", "children"]
OPTIONS_INDEX = {"createMemo": 1, "createSignal": 1, "createOptimistic": 1, "createTrackedEffect": 1, "createStore": 2, "createProjection": 2, "createOptimisticStore": 2, "createEffect": 2, "createRenderEffect": 2}
FUNCTION_VALUES = ["function", "async-function"]
CALLABLE_VALUES = ["identifier", "function", "async-function"]


@dataclass
class Facts:
    """The base relations.

    calls: start, end, callee_start, callee_end, callee_text. call_args: call_start, call_end, pos,
    start, end, value. functions: start, end, body_start, body_end, name, name_start, name_end, exported,
    is_async, ord. binding_names: init_start, init_end, name, start, end, array_slot. entities: start_byte,
    end_byte, symbol, type_text. symbols: id, alias_target, name, decl_path. regions: group, start, end, label (see
    ``readers.regions``). returns: start, end, value, type_text, control_tests. imports: module, imported, start.
    Optional: elements: start, end, name_start, name_end. after_await: start, end of calls after an await. params: fn_start,
    fn_end, pos, shape, start, end.
    """

    spark: SparkSession
    calls: DataFrame
    call_args: DataFrame
    functions: DataFrame
    binding_names: DataFrame
    entities: DataFrame
    symbols: DataFrame
    regions: DataFrame
    returns: DataFrame
    imports: DataFrame
    elements: DataFrame | None = None
    after_await: DataFrame | None = None
    params: DataFrame | None = None


def _points(df: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    return df.select(*FILE, *keep, F.col(start).alias("p_start"), F.col(end).alias("p_end"))


def _intervals(df: DataFrame, start: str, end: str, keep: dict[str, str]) -> DataFrame:
    return df.select(*FILE, F.col(start).alias("i_start"), F.col(end).alias("i_end"), *[F.col(a).alias(b) for a, b in keep.items()])


def _inside(points: DataFrame, intervals: DataFrame, how: str = "left_semi") -> DataFrame:
    return spans.containing(points, intervals, FILE, SLOT, how)


class Analysis:
    """Relations derived from :class:`Facts`; those used often are kept as tables in the shared folder."""

    def __init__(self, facts: Facts):
        self.f, self.folder = facts, scratch_path(facts.spark, "analysis")

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a table; after every few the driver drops the plans of those before."""
        return keep(df, f"{self.folder}/{name}")

    # symbols

    @cached_property
    def roots(self) -> DataFrame:
        """project_id, id, root, primitive: the end of each symbol's alias chain, and the framework name it stands for."""
        s = self.f.symbols.select("project_id", "id", F.nullif("alias_target", F.lit("")).alias("alias_target"), "name", "decl_path").dropDuplicates(["project_id", "id"])
        s = self._kept("symbols", s)
        key = lambda c: F.concat_ws("\x00", "project_id", c)
        known = s.select(key("id").alias("k"))
        edges = s.where("alias_target is not null").select(key("id").alias("child"), key("alias_target").alias("parent"))
        edges = edges.join(known, F.col("parent") == F.col("k"), "left_semi")
        ends = fixpoint.roots_by_doubling(edges).select("node", "root")
        named = s.withColumn("k", key("id")).join(ends, F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k"))
        end_names = s.select(key("id").alias("e_k"), F.when(F.col("decl_path").contains(FRAMEWORK), F.col("name")).alias("primitive"))
        return self._kept("roots", named.join(end_names, F.col("root") == F.col("e_k"), "left").select("project_id", "id", "root", "primitive"))

    @cached_property
    def located_roots(self) -> DataFrame:
        """Root and primitive of the entity at each exact span (the greatest symbol of several)."""
        e = self.f.entities.where("symbol is not null and symbol <> ''").groupBy(*FILE, "start_byte", "end_byte").agg(F.max("symbol").alias("symbol"))
        e = e.join(self.roots.withColumnRenamed("id", "symbol"), ["project_id", "symbol"], "left")
        return self._kept("located_roots", e.select(*FILE, "start_byte", "end_byte", F.coalesce("root", F.concat_ws("\x00", "project_id", "symbol")).alias("root"), "primitive"))

    def _root_at(self, df: DataFrame, start: str, end: str, prefix: str) -> DataFrame:
        """Adds the root and primitive of the entity at an exact span; null where there is none."""
        e = self.located_roots.toDF("e_p", "e_f", "e_s", "e_e", f"{prefix}root", f"{prefix}primitive")
        on = (F.col("project_id") == F.col("e_p")) & (F.col("path") == F.col("e_f")) & (F.col(start) == F.col("e_s")) & (F.col(end) == F.col("e_e"))
        return df.join(e, on, "left").drop("e_p", "e_f", "e_s", "e_e")

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with the callee's root and primitive; the callee's text counts only where it has no entity."""
        c = self._root_at(self.f.calls, "callee_start", "callee_end", "callee_")
        known = sorted({*OWNED_ARGUMENT_0, *LEAF_ARGUMENT_0, *LEAF_FORBIDDEN, *ALLOWED_ARGUMENT_0, *TRACKED_ARGUMENT_0, *SOURCES, "runWithOwner", "onCleanup", "refresh", "affects", "action", "merge"})
        by_text = F.when(F.col("callee_root").isNull() & text.last_segment(F.col("callee_text")).isin(*known), text.last_segment(F.col("callee_text")))
        return self._kept("calls", c.withColumn("primitive", F.coalesce("callee_primitive", by_text)).drop("callee_primitive"))

    @cached_property
    def args(self) -> DataFrame:
        """Arguments with the primitive of their call."""
        c = self.calls.select(*FILE, F.col("start").alias("call_start"), F.col("end").alias("call_end"), "primitive", "callee_root")
        return self._kept("args", self.f.call_args.join(c, [*FILE, "call_start", "call_end"]))

    # functions as nodes

    @cached_property
    def nodes(self) -> DataFrame:
        """Functions with node number, name (own, or of the variable they initialise) and root of the name's symbol."""
        b = self.f.binding_names.where("array_slot is null").select(F.col("project_id").alias("b_p"), F.col("path").alias("b_f"), F.col("init_start").alias("b_s"), F.col("init_end").alias("b_e"), F.col("name").alias("b_name"), F.col("start").alias("b_ns"), F.col("end").alias("b_ne"))
        on = (F.col("project_id") == F.col("b_p")) & (F.col("path") == F.col("b_f")) & (F.col("start") == F.col("b_s")) & (F.col("end") == F.col("b_e"))
        n = self.f.functions.join(b, on, "left").withColumn("name", F.coalesce("name", "b_name")).withColumn("name_start", F.coalesce("name_start", "b_ns")).withColumn("name_end", F.coalesce("name_end", "b_ne"))
        n = n.drop("b_p", "b_f", "b_s", "b_e", "b_name", "b_ns", "b_ne")
        n = self._root_at(n, "name_start", "name_end", "fn_").withColumn("node", F.xxhash64(*FILE, "start", "end"))
        return self._kept("nodes", n)

    @cached_property
    def named_nodes(self) -> DataFrame:
        """One node per root of a function's own name: the last in order."""
        return self.nodes.where("fn_root is not null").groupBy("fn_root").agg(F.max_by("node", "ord").alias("target"))

    @cached_property
    def returned_nodes(self) -> DataFrame:
        """(maker, returned): functions that a function returns."""
        own = self.nodes.select(*FILE, F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("node").alias("returned"))
        given = self.f.returns.where(F.col("value").isin(*FUNCTION_VALUES)).select(*FILE, F.col("start").alias("p_start"), F.col("end").alias("p_end")).distinct()
        pairs = spans.containing(own.join(given, [*FILE, "p_start", "p_end"]), _intervals(self.nodes, "start", "end", {"node": "maker", "ord": "i_ord"}), FILE, SLOT)
        pairs = pairs.where("maker <> returned").withColumn("size", F.col("i_end") - F.col("i_start"))
        return pairs.groupBy("returned").agg(F.min_by("maker", F.struct("size", "i_ord")).alias("maker"))

    @cached_property
    def _factories(self) -> tuple[DataFrame, DataFrame]:
        """Nodes by symbol root, and (maker, returned), together to a fixpoint.

        A variable set to a call is a function if what the call's target returns is one; a function that returns a call returns what that call's
        target does. Each can make more of the other, so rounds go on until neither has anything new.
        """
        spark, folder = self.f.spark, f"{self.folder}/factories"
        at = self.calls.where("callee_root is not null").select(*FILE, F.col("start").alias("init_start"), F.col("end").alias("init_end"), "callee_root")
        sites = self._root_at(self.f.binding_names.where("array_slot is null").join(at, [*FILE, "init_start", "init_end"]), "start", "end", "h_").where("h_root is not null")
        sites = self._kept("factory-sites", sites.select("callee_root", F.col("h_root").alias("fn_root")).distinct())
        given = self.f.returns.select(*FILE, F.col("start").alias("init_start"), F.col("end").alias("init_end")).distinct().join(at, [*FILE, "init_start", "init_end"])
        given = self._kept("factory-given", given)
        passed = self._kept("factory-returns", self.at_calls(given, "init_start", "init_end", ("owner",)).where("owner is not null").select("callee_root", F.col("owner").alias("maker")).distinct())
        roots_of, made_by = self.named_nodes.schema, self.returned_nodes.select("maker", "returned").schema
        seen = [fixpoint._write(self.named_nodes, f"{folder}/roots/r=0", F.count(F.lit(1))), fixpoint._write(self.returned_nodes.select("maker", "returned"), f"{folder}/made/r=0", F.count(F.lit(1)))]
        r, new = 0, all(seen)
        read = lambda name, schema, n: spark.read.schema(schema).parquet(*[f"{folder}/{name}/r={k}" for k in range(n)])
        while new:
            known, made = read("roots", roots_of, r + 1), read("made", made_by, r + 1)
            gives = known.join(made, F.col("target") == F.col("maker")).select(F.col("fn_root").alias("callee_root"), "returned")
            more = gives.join(sites, "callee_root").groupBy("fn_root").agg(F.max("returned").alias("target")).join(known.select("fn_root"), "fn_root", "left_anti")
            also = gives.join(passed, "callee_root").select("maker", "returned").distinct().join(made, ["maker", "returned"], "left_anti")
            r += 1
            new = fixpoint._write(more.select("fn_root", "target"), f"{folder}/roots/r={r}", F.count(F.lit(1))) + fixpoint._write(also, f"{folder}/made/r={r}", F.count(F.lit(1)))
        return read("roots", roots_of, r + 1), read("made", made_by, r + 1)

    @cached_property
    def by_root(self) -> DataFrame:
        """One node per symbol root: the function of that name, else the function that the call gives to which the variable is set."""
        return self._factories[0]

    @property
    def returned(self) -> DataFrame:
        """(maker, returned): functions that a function returns, itself or through the calls it returns."""
        return self._factories[1]

    def enclosing(self, df: DataFrame, start: str, end: str, ids: list[str]) -> DataFrame:
        """Adds the innermost function around a span as ``owner`` (null at module level)."""
        pairs = spans.containing(_points(df, start, end, ids), _intervals(self.nodes, "start", "end", {"node": "i_node", "ord": "i_ord"}), FILE, SLOT)
        inner = spans.innermost(pairs, [*FILE, *ids], F.col("i_node"), F.col("i_ord")).withColumnRenamed("picked", "owner")
        return df.join(inner, [*FILE, *ids], "left")

    def callback_nodes(self, args: DataFrame) -> DataFrame:
        """(…, target): the outermost function inside an argument, else the function that an identifier names."""
        fns = self.nodes.select(*FILE, F.col("node").alias("g_node"), F.col("ord").alias("g_ord"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        boxes = args.select(*FILE, "call_start", "call_end", "pos", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
        inside = spans.containing(fns, boxes, FILE, SLOT)
        outer = inside.groupBy(*FILE, "call_start", "call_end", "pos").agg(F.max_by("g_node", F.struct(F.col("p_end") - F.col("p_start"), "g_ord")).alias("inner_node"))
        named = self._root_at(args.where("value = 'identifier'"), "start", "end", "arg_").join(self.by_root, F.col("arg_root") == F.col("fn_root")).select(*FILE, "call_start", "call_end", "pos", F.col("target").alias("named_node"))
        keys = [*FILE, "call_start", "call_end", "pos"]
        return args.join(outer, keys, "left").join(named.dropDuplicates(keys), keys, "left").withColumn("target", F.coalesce("inner_node", "named_node")).drop("inner_node", "named_node")

    @cached_property
    def callbacks(self) -> DataFrame:
        """All arguments with the function they are."""
        return self._kept("callbacks", self.callback_nodes(self.args))

    @cached_property
    def handlers(self) -> DataFrame:
        """(label, target): the functions of the regions in which callbacks run."""
        h = self.f.regions.where("group = 'callbackRoles'").select(*FILE, F.col("start").alias("call_start"), F.col("end").alias("call_end"), F.lit(0).alias("pos"), "start", "end", F.lit("identifier").alias("value"), "label")
        return self._kept("handlers", self.callback_nodes(h).where("target is not null").select("label", "target").distinct())

    # execution roles

    @cached_property
    def _boxes(self) -> DataFrame:
        """All that can lie around a span and decide its owner or role, in one relation: functions, arguments of primitives and regions, by kind."""
        a, r = self.args, self.f.regions
        pos, of = F.col("pos"), F.col("primitive").isin
        by_argument = (
            F.when((pos == 1) & of(*UNOWNED_ARGUMENT_1), "in_apply")
            .when((pos == 0) & of(*ALLOWED_ARGUMENT_0), "in_allowed")
            .when((pos == 0) & of(*TRACKED_ARGUMENT_0) & F.col("value").isin(*CALLABLE_VALUES), "in_argument")
        )
        by_region = F.when(F.col("group") == "trackedRegions", "in_tracked").when(F.col("group") == "callbackRoles", "callback")
        box = lambda df, kind, **more: df.select(*FILE, F.col("start").alias("i_start"), F.col("end").alias("i_end"), kind.alias("kind"), *[more.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("i_node", "bigint"), ("i_ord", "bigint"), ("i_label", "string"))]).where("kind is not null")
        boxes = box(self.nodes, F.lit("function"), i_node=F.col("node"), i_ord=F.col("ord").cast("bigint"))
        return self._kept("boxes", boxes.unionByName(box(a, by_argument).distinct()).unionByName(box(r, by_region, i_label=F.col("label"))))

    def placed(self, df: DataFrame, start: str, end: str, ids: list[str]) -> DataFrame:
        """(FILE, ids, owner, role) of the distinct spans of ``df``: one containment join with all kinds of boxes, then the first rule of roles that holds."""
        points = _points(df, start, end, ids).distinct()
        pairs = spans.containing(points, self._boxes, FILE, SLOT)
        kind = F.col("kind")
        flags = [F.bool_or(kind == n).alias(n) for n in ("in_apply", "in_allowed", "in_tracked", "in_argument")]
        owner = F.min_by("i_node", F.when(kind == "function", F.struct(F.col("i_end") - F.col("i_start"), "i_ord"))).alias("owner")
        callback = F.min_by("i_label", F.when(kind == "callback", F.struct("i_start", "i_end"))).alias("callback")
        keys = [*FILE, *ids]
        found = pairs.groupBy(*keys).agg(owner, *flags, callback)
        out = points.select(*keys).join(found, keys, "left")
        on = lambda n: F.coalesce(n, F.lit(False))
        role = rules.execution_role(on("in_apply"), on("in_allowed"), on("in_tracked"), on("in_argument"), F.col("callback"))
        return out.select(*keys, "owner", role.alias("role"))

    @cached_property
    def placed_calls(self) -> DataFrame:
        """Every call span once, with the innermost function around it and its execution role: most relations look calls up here."""
        return self._kept("placed_calls", self.placed(self.calls, "start", "end", ["start", "end"]))

    def at_calls(self, df: DataFrame, start: str = "start", end: str = "end", keep: tuple[str, ...] = ("owner", "role")) -> DataFrame:
        """Adds owner and role of rows that stand at calls."""
        p = self.placed_calls.select(*FILE, F.col("start").alias(start), F.col("end").alias(end), *keep)
        return df.join(p, [*FILE, start, end], "left")

    # sources, reads and writes

    @cached_property
    def sources(self) -> DataFrame:
        """root, source (accessor or setter), name: bindings initialised by a source primitive; slot 0 reads, slot 1 writes."""
        made = self.calls.where(F.col("primitive").isin(*SOURCES)).select(*FILE, F.col("start").alias("init_start"), F.col("end").alias("init_end"), "primitive")
        b = self.f.binding_names.join(made, [*FILE, "init_start", "init_end"])
        kind = F.when(F.coalesce("array_slot", F.lit(0)) == 0, "accessor").when(F.col("array_slot") == 1, "setter")
        direct = self._root_at(b, "start", "end", "b_").where("b_root is not null").select(F.col("b_root").alias("root"), kind.alias("source"), "name").where("source is not null")
        # aliases: a variable initialised by an identifier that is a source is one too, until nothing is new
        first = self._root_at(self.f.binding_names.where("array_slot is null"), "start", "end", "to_")
        via = self._root_at(first, "init_start", "init_end", "from_").where("to_root is not null and from_root is not null").select(F.col("from_root").alias("src"), F.col("to_root").alias("dst"))
        tagged = direct.select(F.col("root").alias("node"), F.concat_ws(" ", "source", "name").alias("tag"))
        every = fixpoint.spread(tagged, via)
        return self._kept("sources", every.select(F.col("node").alias("root"), F.substring_index("tag", " ", 1).alias("source"), F.substring_index("tag", " ", -1).alias("name")).groupBy("root").agg(F.min("source").alias("source"), F.min("name").alias("name")))

    @cached_property
    def props_roots(self) -> DataFrame:
        """(root, component): symbols that hold the props of a component, and the component they come from.

        The first parameter of a component is one, and so is what is initialised by one of these by name, or by ``merge`` with one of
        these among its arguments, until nothing is new; where several come in question the first found counts.
        """
        if self.f.params is None:
            return self.roots.where("false").select("root", F.col("root").alias("component"))
        own = self.nodes.where(text.component_name(F.col("name"))).select(*FILE, F.col("start").alias("fn_start"), F.col("end").alias("fn_end"), F.col("name").alias("tag"))
        first = self._root_at(self.f.params.where("pos = 0 and shape <> 'object'"), "start", "end", "p_").where("p_root is not null").join(own, [*FILE, "fn_start", "fn_end"])
        bound = self._root_at(self.f.binding_names, "start", "end", "to_").where("to_root is not null").select(*FILE, "init_start", "init_end", "to_root")
        by_name = self._root_at(bound, "init_start", "init_end", "from_").select(F.col("from_root").alias("src"), F.col("to_root").alias("dst"), F.struct(*FILE, "init_start").alias("ord"))
        given = self._root_at(self.args.where("primitive = 'merge'"), "start", "end", "a_").select(*FILE, F.col("call_start").alias("init_start"), F.col("call_end").alias("init_end"), "a_root")
        merged = given.join(bound, [*FILE, "init_start", "init_end"]).select(F.col("a_root").alias("src"), F.col("to_root").alias("dst"), F.struct(*FILE, "init_start").alias("ord"))
        steps = by_name.unionByName(merged).where("src is not null")
        found = fixpoint.first_wins(first.select(F.col("p_root").alias("node"), "tag"), steps)
        return self._kept("props_roots", found.select(F.col("node").alias("root"), F.col("tag").alias("component")))

    @cached_property
    def accesses(self) -> DataFrame:
        """Calls of accessors and setters with the enclosing function and the execution role."""
        hit = self.calls.join(self.sources.withColumnRenamed("root", "callee_root"), "callee_root").select(*FILE, "start", "end", "source", "name")
        return self._kept("accesses", self.at_calls(hit))

    def _named(self, upper: bool) -> DataFrame:
        """Spans of the functions with an upper-case initial (components), or with a lower-case one."""
        named = self.nodes.where("name is not null").where(text.component_name(F.col("name")) if upper else ~text.component_name(F.col("name")))
        return _intervals(named, "start", "end", {})

    @cached_property
    def strict_reads(self) -> DataFrame:
        """Reads that count where they stand: not those in helpers, which count at the calls of the helper."""
        a = self.accesses.where("source = 'accessor'").select(*FILE, "start", "end", "role", "name")
        return _inside(_points(a, "start", "end", ["start", "end", "role", "name"]), self._named(False), "left_anti").select(*FILE, "start", "end", "role", "name")

    # call graph, reachability and summaries

    @cached_property
    def call_edges(self) -> DataFrame:
        """src, dst, call: direct calls between functions; src is null for calls at module level."""
        hit = self.calls.join(self.by_root, F.col("callee_root") == F.col("fn_root")).select(*FILE, "start", "end", F.col("target").alias("dst"))
        placed = self.at_calls(hit, keep=("owner",))
        return self._kept("call_edges", placed.select(*FILE, "start", "end", F.col("owner").alias("src"), "dst"))

    @cached_property
    def reachable(self) -> DataFrame:
        """Nodes reachable from components, exported functions, callbacks of primitives and targets of module-level calls."""
        named = self.nodes.where(text.component_name(F.col("name")) | F.col("exported")).select("node")
        called = self.call_edges.where("src is null").select(F.col("dst").alias("node"))
        passed = self.callbacks.where("primitive is not null and target is not null").select(F.col("target").alias("node"))
        seeds = named.union(called).union(passed).distinct().select("node", F.lit(0).alias("tag"))
        return fixpoint.spread(seeds, self.call_edges.where("src is not null").select("src", "dst")).select("node")

    @cached_property
    def summaries(self) -> DataFrame:
        """(node, name): the accessors a function reads, itself or through what it calls, outside tracking scopes."""
        own = self.accesses.where("source = 'accessor' and owner is not null").select(F.col("owner").alias("node"), F.col("name").alias("tag"))
        back = self.call_edges.where("src is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self._kept("summaries", fixpoint.spread(own, back).withColumnRenamed("tag", "name"))

    @cached_property
    def summary_reads(self) -> DataFrame:
        """Calls of functions that read, as reads at the call, with the call's own role."""
        at = self.call_edges.join(self.summaries, F.col("dst") == F.col("node")).select(*FILE, "start", "end", "name")
        one = at.groupBy(*FILE, "start", "end").agg(F.min("name").alias("name"))
        one = _inside(_points(one, "start", "end", ["start", "end", "name"]), self._named(True)).select(*FILE, "start", "end", "name")
        return self.at_calls(one, keep=("role",))

    # ownership

    @cached_property
    def owner_contexts(self) -> DataFrame:
        """(node, context): owned, unowned and leaf bits of each function, by the lattice fixpoint."""
        n = self.nodes
        seeds = n.where(text.component_name(F.col("name"))).select("node", F.lit(rules.OWNED).alias("context"))
        lower = n.where(F.col("exported") & F.col("name").isNotNull() & ~text.component_name(F.col("name"))).select("node", F.lit(rules.UNOWNED).alias("context"))
        module_calls = self.call_edges.where("src is null").select(F.col("dst").alias("node"), F.lit(rules.UNOWNED).alias("context"))
        edge = (
            F.when((F.col("pos") == 0) & F.col("primitive").isin(*OWNED_ARGUMENT_0), rules.OWNED)
            .when((F.col("pos") == 1) & F.col("primitive").isin(*UNOWNED_ARGUMENT_1), rules.UNOWNED)
            .when((F.col("pos") == 0) & F.col("primitive").isin(*LEAF_ARGUMENT_0), rules.LEAF)
        )
        labelled = self.callbacks.withColumn("sets", edge).where("sets is not null and target is not null")
        placed = self.at_calls(labelled, "call_start", "call_end", ("owner",))
        passed = placed.where("owner is not null").select(F.col("owner").alias("src"), F.col("target").alias("dst"), "sets")
        top = placed.where("owner is null").select(F.col("target").alias("node"), F.col("sets").alias("context"))
        by_event = self.handlers.where("label in ('event-handler', 'directive-apply')").select(F.col("target").alias("node"), F.lit(rules.UNOWNED).alias("context"))
        direct = self.call_edges.where("src is not null").select("src", "dst", F.lit(None).cast("int").alias("sets"))
        start = seeds.union(lower).union(module_calls).union(top).union(by_event)
        return self._kept("owner_contexts", fixpoint.lattice(start, passed.union(direct)))

    @cached_property
    def missing_owners(self) -> DataFrame:
        """Effects, cleanups and boundaries that some caller runs without an owner, outside regions that give one."""
        operation = F.when(F.col("primitive").isin("createEffect", "createRenderEffect", "createTrackedEffect"), "effect").when(F.col("primitive") == "onCleanup", "cleanup")
        ops = self.calls.withColumn("operation", operation).where("operation is not null").select(*FILE, "start", "end", "operation")
        ops = ops.unionByName(self.boundaries.select("*", F.lit("boundary").alias("operation"))).unionByName(self.settled_cleanups.select("*", F.lit("settled-cleanup").alias("operation")))
        giving = self.args.where(((F.col("pos") == 0) & F.col("primitive").isin(*PROVIDING_0) | (F.col("pos") == 1) & (F.col("primitive") == "runWithOwner")) & F.col("value").isin(*CALLABLE_VALUES))
        free = _inside(_points(ops, "start", "end", ["start", "end", "operation"]), _intervals(giving, "start", "end", {}), "left_anti").select(*FILE, "start", "end", "operation")
        free = self._kept("free-operations", free)
        placed = self.enclosing(free, "start", "end", ["start", "end"]).join(self.owner_contexts.withColumnRenamed("node", "owner"), "owner", "left")
        n = self.nodes.select(F.col("node").alias("owner"), F.col("name").alias("fn_name"), "exported")
        placed = placed.join(n, "owner", "left")
        bits = F.when(F.col("owner").isNull(), rules.UNOWNED).otherwise(F.coalesce("context", F.lit(0)))
        mask = F.when(F.col("operation").isin("effect", "boundary"), rules.UNOWNED).otherwise(rules.UNOWNED + rules.LEAF)
        uncertain = F.coalesce(F.col("exported") & ~text.component_name(F.col("fn_name")), F.lit(False)) & (bits.bitwiseAND(F.lit(rules.UNOWNED)) != 0)
        return placed.select(*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "operation", (bits.bitwiseAND(mask) != 0).alias("report"), uncertain.alias("uncertain"))

    # the other streams

    @cached_property
    def boundaries(self) -> DataFrame:
        """Markup elements of the framework's loading boundary, under whatever name they are imported."""
        if self.f.elements is None:
            return self.f.calls.where("false").select(*FILE, "start", "end")
        return self._kept("boundaries", self._root_at(self.f.elements, "name_start", "name_end", "el_").where("el_primitive = 'Loading'").select(*FILE, "start", "end"))

    @cached_property
    def settled_cleanups(self) -> DataFrame:
        """Calls of onSettled whose callback returns a function."""
        boxes = _intervals(self.args.where((F.col("pos") == 0) & (F.col("primitive") == "onSettled")), "start", "end", {"call_start": "call_start", "call_end": "call_end"})
        given = self.f.returns.where("value = 'function'")
        hit = spans.containing(_points(given, "start", "end", []), boxes, FILE, SLOT)
        return hit.select(*FILE, F.col("call_start").alias("start"), F.col("call_end").alias("end")).distinct()

    @cached_property
    def async_sources(self) -> DataFrame:
        """Roots of accessors whose computation is an async function."""
        made = self.args.where((F.col("pos") == 0) & (F.col("value") == "async-function") & F.col("primitive").isin(*SOURCES)).select(*FILE, F.col("call_start").alias("init_start"), F.col("call_end").alias("init_end"))
        b = self.f.binding_names.where("coalesce(array_slot, 0) = 0").join(made, [*FILE, "init_start", "init_end"])
        return self._root_at(b, "start", "end", "b_").select(F.col("b_root").alias("callee_root")).distinct()

    @cached_property
    def async_reads(self) -> DataFrame:
        """Reads of pending values: role, the leaf owner around them, and whether a loading boundary is."""
        hit = self.calls.join(self.async_sources, "callee_root", "left_semi").select(*FILE, "start", "end", F.col("callee_text").alias("subject"))
        hit = self._kept("async-calls", self.at_calls(hit, keep=("role",)))
        leaf = _intervals(self.args.where((F.col("pos") == 0) & F.col("primitive").isin(*LEAF_ARGUMENT_0)), "start", "end", {"primitive": "leaf_name"})
        inside = spans.containing(_points(hit, "start", "end", ["start", "end"]), leaf, FILE, SLOT)
        owner = inside.groupBy(*FILE, "start", "end").agg(F.min_by("leaf_name", F.col("i_end") - F.col("i_start")).alias("leaf_owner"))
        hit = under_boundary(hit.join(owner, [*FILE, "start", "end"], "left"), self.boundaries)
        return hit.select(*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "subject", "role", "leaf_owner", "under_loading")

    @cached_property
    def actions(self) -> DataFrame:
        """Calls of what ``action`` returned."""
        made = self.calls.where("primitive = 'action'").select(*FILE, F.col("start").alias("init_start"), F.col("end").alias("init_end"))
        bound = self._root_at(self.f.binding_names.where("array_slot is null").join(made, [*FILE, "init_start", "init_end"]), "start", "end", "b_").select(F.col("b_root").alias("callee_root")).distinct()
        hit = self.calls.join(bound, "callee_root", "left_semi").select(*FILE, "start", "end", F.col("callee_text").alias("subject"))
        return self.at_calls(hit, keep=("role",)).select(*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "subject", "role")

    @cached_property
    def target_checks(self) -> DataFrame:
        """Targets of refresh and affects that are no sources or can't be resolved, and keys given with an accessor."""
        a = self.args.where(F.col("primitive").isin("refresh", "affects"))
        first = self._root_at(a.where("pos = 0"), "start", "end", "t_")
        known = self.sources.select(F.col("root").alias("t_root"), F.lit(True).alias("is_source"), "source")
        stores = self.calls.where(F.col("primitive").isin("createStore", "createOptimisticStore", "createProjection")).select(*FILE, F.col("start").alias("init_start"), F.col("end").alias("init_end"))
        store_roots = self._root_at(self.f.binding_names.join(stores, [*FILE, "init_start", "init_end"]), "start", "end", "s_").select(F.col("s_root").alias("t_root"), F.lit(True).alias("is_store")).distinct()
        keyed = a.where("pos = 1").select(*FILE, "call_start", "call_end", F.lit(True).alias("has_keys"))
        x = first.join(known, "t_root", "left").join(store_roots, "t_root", "left").join(keyed, [*FILE, "call_start", "call_end"], "left")
        name = (
            F.when(F.col("t_root").isNull(), F.concat("primitive", F.lit("-target-unresolved")))
            .when(F.col("is_source").isNull(), F.concat(F.lit("invalid-"), "primitive", F.lit("-target")))
            .when((F.col("primitive") == "affects") & F.col("has_keys") & F.col("is_store").isNull(), "affects-keys-on-accessor")
        )
        code = F.when(name.endswith("unresolved"), "SC9003").when(name == "affects-keys-on-accessor", "SC7004").otherwise("SC7003")
        return x.select(*FILE, F.col("call_start").alias("start_byte"), F.col("call_end").alias("end_byte"), code.alias("code"), name.alias("rule"), F.col("primitive").alias("subject")).where("rule is not null")

    @cached_property
    def optional_violations(self) -> DataFrame:
        """Reads after an await, and components that take their first parameter apart."""
        at = [*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte")]
        out = self.accesses.where("false").select(*at, F.lit("").alias("code"), F.lit("").alias("rule"), F.lit("").alias("subject"))
        if self.f.after_await is not None:
            late = reads_after_await(self.accesses.where("source = 'accessor'"), self.f.after_await)
            out = out.unionByName(late.select(*at, F.lit("SC1002").alias("code"), F.lit("reactive-read-after-await").alias("rule"), F.col("name").alias("subject")))
        if self.f.params is not None:
            own = self.nodes.where(text.component_name(F.col("name"))).select(*FILE, F.col("start").alias("fn_start"), F.col("end").alias("fn_end"), F.col("name").alias("subject"))
            apart = self.f.params.where("pos = 0 and shape = 'object'").join(own, [*FILE, "fn_start", "fn_end"])
            out = out.unionByName(apart.select(*at, F.lit("SC1003").alias("code"), F.lit("component-props-destructure").alias("rule"), "subject"))
        return out

    @cached_property
    def leaf_operations(self) -> DataFrame:
        """Forbidden operations inside leaf owners: one row per owner around them."""
        with_function = self.args.where((F.col("pos") == 0) & F.col("value").isin(*FUNCTION_VALUES)).select(*FILE, F.col("call_start").alias("start"), F.col("call_end").alias("end")).distinct().withColumn("has_function", F.lit(True))
        c = self.calls.join(with_function, [*FILE, "start", "end"], "left")
        bad = c.where(F.col("primitive").isin(*LEAF_FORBIDDEN) | F.col("primitive").isin(*LEAF_FORBIDDEN_WITH_FUNCTION) & F.col("has_function")).select(*FILE, "start", "end", "primitive")
        leaf = self.args.where((F.col("pos") == 0) & F.col("primitive").isin(*LEAF_ARGUMENT_0))
        pairs = spans.containing(_points(bad, "start", "end", ["primitive"]), _intervals(leaf, "start", "end", {"call_start": "leaf_start"}), FILE, SLOT)
        return pairs.select(*FILE, F.col("p_start").alias("start_byte"), F.col("p_end").alias("end_byte"), "primitive")

    @cached_property
    def cleanup_returns(self) -> DataFrame:
        """Values returned from callbacks whose result is a cleanup: functions are sound, identifiers open, others invalid."""
        boxes = _intervals(self.args.where((F.col("pos") == 0) & F.col("primitive").isin(*CLEANUP_RETURN_0) | (F.col("pos") == 1) & F.col("primitive").isin(*UNOWNED_ARGUMENT_1)), "start", "end", {"primitive": "box"})
        r = self.f.returns
        hit = spans.containing(_points(r, "start", "end", ["value", "type_text"]), boxes, FILE, SLOT)
        cleanup_type = text.cleanup_type(F.col("type_text"))
        status = F.when(F.col("value").isin("function", "undefined") | F.coalesce(cleanup_type, F.lit(False)), "sound").when(F.col("value").isin("identifier", "call") & F.col("type_text").isNull(), "unresolved").otherwise("invalid")
        return hit.select(*FILE, F.col("p_start").alias("start_byte"), F.col("p_end").alias("end_byte"), status.alias("status"), F.col("box").alias("subject")).distinct()

    @cached_property
    def conditional_returns(self) -> DataFrame:
        """Components that return on a test with a reactive read in it."""
        tests = self.f.returns.select(*FILE, "start", "end", F.explode("control_tests").alias("t")).select(*FILE, "start", "end", F.col("t.start").alias("i_start"), F.col("t.end").alias("i_end"))
        r = self.accesses.where("source = 'accessor'").select(*FILE, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        hit = self._kept("tested-returns", spans.containing(r, tests, FILE, SLOT).select(*FILE, "start", "end").distinct())
        owned = self.enclosing(hit, "start", "end", ["start", "end"]).join(self.nodes.where(text.component_name(F.col("name"))).select(F.col("node").alias("owner")), "owner", "left_semi")
        return owned.select(*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))

    @cached_property
    def uncovered_markup(self) -> DataFrame:
        """Markup expressions that no region of the execution map classifies."""
        r = self.f.regions
        open_ = r.where("group = 'jsxOperations' and label = 'jsx-expression'")
        known = r.where("group in ('trackedRegions', 'untrackedRegions', 'callbackRoles') or group = 'jsxOperations' and label = 'component-property'")
        return _inside(_points(open_, "start", "end", []), _intervals(known, "start", "end", {}), "left_anti").select(*FILE, F.col("p_start").alias("start_byte"), F.col("p_end").alias("end_byte"))

    @cached_property
    def directive_creations(self) -> DataFrame:
        """Primitives created by a directive's apply function, itself or through what it calls."""
        seeds = self.handlers.where("label = 'directive-apply'").select(F.col("target").alias("node"), F.lit(0).alias("tag"))
        inside = fixpoint.spread(seeds, self.call_edges.where("src is not null").select("src", "dst")).select(F.col("node").alias("owner"))
        made = self.calls.where(F.col("primitive").isin(*DIRECTIVE_CREATED)).select(*FILE, "start", "end", "primitive")
        return self.at_calls(made, keep=("owner",)).join(inside, "owner", "left_semi").select(*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "primitive")

    @cached_property
    def static_api(self) -> DataFrame:
        """Call-shape violations: effects without an apply function, synchronous nodes that get an async function."""
        shape = self.args.groupBy(*FILE, "call_start", "call_end", "primitive").agg(F.max("pos").alias("last"), F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("first_value"), F.max(F.when(F.col("value") == "sync-options", F.col("pos"))).alias("sync_at"))
        index = F.create_map(*[F.lit(x) for pair in OPTIONS_INDEX.items() for x in pair])[F.col("primitive")]
        name = F.when(F.col("primitive").isin(*UNOWNED_ARGUMENT_1) & (F.col("last") < 1), "missing-effect-function").when((F.col("sync_at") == index) & (F.col("first_value") == "async-function"), "sync-node-received-async")
        code = F.when(name == "missing-effect-function", "SC7001").otherwise("SC7002")
        return shape.select(*FILE, F.col("call_start").alias("start_byte"), F.col("call_end").alias("end_byte"), code.alias("code"), name.alias("rule"), F.col("primitive").alias("subject")).where("rule is not null")

    def contract_violations(self, exports: DataFrame) -> DataFrame:
        """Imports without a contract, and names that their package's contract does not export.

        ``exports`` has name (of the package) and export; packages with a contract but no row for a name lack it.
        """
        i = self.f.imports.where("not module like '.%'")
        matched = contracts.longest_prefix(i.select("module").distinct(), exports.select("name").distinct())
        i = i.join(matched, "module")
        at = [F.col("start").alias("start_byte"), F.col("start").alias("end_byte")]
        lost = i.where("contract is null").groupBy("project_id", "module").agg(F.min(F.struct("path", "start")).alias("f")).select("project_id", F.col("f.path").alias("path"), F.col("f.start").alias("start_byte"), F.col("f.start").alias("end_byte"), F.lit("SC9005").alias("code"), F.lit("package-contract-missing").alias("rule"), F.col("module").alias("subject"))
        e = exports.select(F.col("name").alias("contract"), F.col("export").alias("imported"))
        unknown = i.where("contract is not null and imported is not null").join(e, ["contract", "imported"], "left_anti").select(*FILE, *at, F.lit("SC9001").alias("code"), F.lit("package-contract-export-missing").alias("rule"), F.col("imported").alias("subject"))
        return lost.unionByName(unknown)

    @cached_property
    def _own_streams(self) -> dict[str, DataFrame]:
        return {name: self._kept(f"stream-{name}", df) for name, df in self._streams().items()}

    def streams(self, exports: DataFrame | None = None) -> dict[str, DataFrame]:
        """The inputs of the rule catalogue, kept as tables; with the exports of contracts also what contracts show."""
        own = dict(self._own_streams)
        if exports is not None:
            own["static_violations"] = own["static_violations"].unionByName(self.contract_violations(exports))
        return own

    def _streams(self) -> dict[str, DataFrame]:
        at = [*FILE, F.col("start").alias("start_byte"), F.col("end").alias("end_byte")]
        reads = self._kept("strict-reads", self.strict_reads).select(*at, "role", F.col("name").alias("subject"))
        through = self._kept("summary-reads", self.summary_reads).select(*at, "role", F.col("name").alias("subject"))
        writes = self.accesses.where("source = 'setter'").select(*at, "role", F.col("name").alias("subject"), F.lit(False).alias("allowed_by_option"))
        on_condition = self.conditional_returns.select("*", F.lit("SC1004").alias("code"), F.lit("component-returns-conditionally").alias("rule"), F.lit("").alias("subject"))
        uncovered = self.uncovered_markup.select("*", F.lit("SC9004").alias("code"), F.lit("execution-map-incomplete").alias("rule"), F.lit("").alias("subject"))
        parts = {"static-api": self.static_api, "conditional-returns": on_condition, "uncovered-markup": uncovered, "target-checks": self.target_checks, "optional": self.optional_violations}
        static = reduce(DataFrame.unionByName, [self._kept(name, df) for name, df in parts.items()])
        return {
            "reads": reads.unionByName(through), "writes": writes, "actions": self.actions, "async_reads": self.async_reads,
            "leaf_operations": self.leaf_operations, "cleanup_returns": self.cleanup_returns, "missing_owners": self.missing_owners,
            "creations": self.directive_creations, "static_violations": static,
        }

    def findings(self, exports: DataFrame | None = None) -> DataFrame:
        return rules.findings(self.f.spark, self.streams(exports))


def metrics(analysis: Analysis, found: DataFrame) -> DataFrame:
    """One row of counts of a snapshot: files, functions, summaries, obligations, open ones, and the size of each of the nine streams."""
    f = analysis.f
    one = lambda df, name: df.select(F.lit(name).alias("what"))
    counted = [
        one(f.calls.select(*FILE).union(f.functions.select(*FILE)).distinct(), "files"),
        one(analysis.nodes, "functions"),
        one(analysis.summaries.select("node").distinct(), "summaries"),
        one(found.select("rule", *FILE, "start_byte", "end_byte").distinct(), "obligations"),
        one(found.where("kind = 'uncertifiable'"), "open"),
    ]
    streams = analysis.streams()
    counted += [one(df, name) for name, df in streams.items()]
    names = ["files", "functions", "summaries", "obligations", "open", *streams]
    return reduce(DataFrame.unionByName, counted).groupBy().agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


def forwarded(args: DataFrame, summaries: DataFrame) -> DataFrame:
    """Call sites whose argument at an index goes to a callee that runs its parameter there: (…, execution).

    ``args`` has callee_root and pos; ``summaries`` has root, parameter and execution.
    """
    return args.join(summaries.select(F.col("root").alias("callee_root"), F.col("parameter").alias("pos"), "execution"), ["callee_root", "pos"])


def under_boundary(reads: DataFrame, boundaries: DataFrame) -> DataFrame:
    """reads with under_loading: whether a boundary's span contains them."""
    ids = ["start", "end"]
    hit = _inside(_points(reads, "start", "end", ids), _intervals(boundaries, "start", "end", {})).select(*FILE, *ids, F.lit(True).alias("under_loading")).distinct()
    return reads.join(hit, [*FILE, *ids], "left").withColumn("under_loading", F.coalesce("under_loading", F.lit(False)))


def reads_after_await(accesses: DataFrame, after_await: DataFrame) -> Column | DataFrame:
    """Accesses at the exact spans of calls that come after an await."""
    return accesses.join(after_await.select(*FILE, "start", "end").distinct(), [*FILE, "start", "end"], "left_semi")


def typed_accessor(origin_module: Column, alias_declarations: Column) -> Column:
    """Whether an entity's type comes from the framework, by its module or by where its aliases are declared."""
    declared = F.exists(F.coalesce(alias_declarations, F.array()), lambda d: F.lower(d["location"]["path"]).contains(FRAMEWORK))
    return F.coalesce(origin_module == FRAMEWORK.strip("/").rsplit("/", 1)[-1], F.lit(False)) | F.coalesce(declared, F.lit(False))


def namespace_members(namespaces: DataFrame, names: list[str]) -> DataFrame:
    """symbol::name for every framework name reached through a namespace import; (project_id, symbol) to (project_id, id, primitive)."""
    return namespaces.select("project_id", "symbol", F.explode(F.array(*[F.lit(n) for n in names])).alias("primitive")).select("project_id", F.concat_ws("::", "symbol", "primitive").alias("id"), "primitive")


def destructured_fixes(parameters: DataFrame, references: DataFrame) -> DataFrame:
    """Edits that turn a destructured parameter into a named one: the pattern becomes a fresh name, each reference a member of it.

    ``parameters`` has project_id, path, fn, start, end and names_in_scope; ``references`` has fn, start, end, property and
    safe. A function gets a fix only if all its references are safe; the fresh name is props, else props2, props3 and so on.
    """
    grouped = references.groupBy("fn").agg(F.bool_and("safe").alias("all_safe"), F.collect_list(F.struct("start", "end", "property")).alias("refs"))
    p = parameters.join(grouped, "fn").where("all_safe")
    tries = F.concat(F.array(F.lit("props")), F.transform(F.sequence(F.lit(2), F.size("names_in_scope") + 2), lambda k: F.concat(F.lit("props"), k.cast("string"))))
    p = p.withColumn("fresh", F.filter(tries, lambda n: ~F.array_contains("names_in_scope", n))[0])
    member = F.transform("refs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.concat(F.col("fresh"), F.lit("."), r["property"]).alias("new_text")))
    own = F.array(F.struct(F.col("start"), F.col("end"), F.col("fresh").alias("new_text")))
    return p.select("project_id", "path", "fn", F.array_sort(F.concat(own, member)).alias("edits"))


def calls_after_await(flow: DataFrame) -> DataFrame:
    """(fn, call) for calls that run only after an await, from each function's ordered control-flow events.

    ``flow`` has fn and events: an array of (kind, call) with kind await, call, if, else, end, loop or return. At the end of a
    branch both sides must have awaited, unless one has returned; what a loop's body awaits does not count after
    it. The fold runs per function on its own array, in Arrow batches; no function is split or gathered.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for fn, events in zip(batch["fn"], batch["events"]):
                state, stack = (False, True), []  # awaited, reachable
                for e in events if events is not None else ():
                    kind = e["kind"]
                    if kind == "await":
                        state = (True, state[1])
                    elif kind == "call" and state[0] and state[1]:
                        rows.append((fn, e["call"]))
                    elif kind in ("if", "loop"):
                        stack.append([kind, state, None])
                    elif kind == "else":
                        stack[-1][2], state = state, stack[-1][1]
                    elif kind == "return":
                        state = (state[0], False)
                    elif kind == "end":
                        opened, before, first = stack.pop()
                        if opened == "loop":
                            state = before
                        else:
                            sides = [s for s in (state, first if first is not None else before) if s[1]]
                            state = (all(s[0] for s in sides), True) if sides else (state[0], False)
            yield pd.DataFrame(rows, columns=["fn", "call"])

    return flow.select("fn", "events").mapInPandas(run, "fn string, call bigint")


def context_label(role: Column, function_name: Column) -> Column:
    """Where a finding stands, in words."""
    return F.concat_ws(" in ", role, F.coalesce(function_name, F.lit("module")))


def terminal_cleanup_fixes(calls: DataFrame) -> DataFrame:
    """Edits that turn a cleanup call at the end of its callback into a returned function.

    ``calls`` has project_id, path, source, start, end, arg_start, arg_end and body_end (before the closing brace); only calls
    with nothing but blanks and semicolons after them get a fix.
    """
    tail = text.byte_slice(F.col("source"), F.col("end"), F.col("body_end"))
    ends = calls.where(tail.rlike(r"^[\s;]*$"))
    edit = lambda a, b, t: F.struct(F.col(a).alias("start"), F.col(b).alias("end"), F.lit(t).alias("new_text"))
    return ends.select("project_id", "path", "start", F.array(edit("start", "arg_start", "return "), edit("arg_end", "end", "")).alias("edits"))
