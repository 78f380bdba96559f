"""Package contracts: matching by longest prefix, tiers, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = """schemaVersion int, package struct<name string, version string>,
exports map<string, struct<kind string, reactiveReads array<struct<kind string, path string>>, callbacks array<struct<argument int, execution string>>, asyncBehavior string>>,
evidence struct<kind string>"""

#: What a contract may say.
EXPORT_KINDS, EXECUTIONS, EVIDENCE = ["function", "value"], ["inline", "tracked", "deferred"], ["generated", "reviewed", "trusted"]


def prefixes(module: Column) -> Column:
    """``a``, ``a/b`` and ``a/b/c`` of ``a/b/c``: what a module may be matched by."""
    parts = F.split(module, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(modules: DataFrame, contracts: DataFrame) -> DataFrame:
    """module and the longest contract name that is the module or stands before one of its slashes; null if none.

    Every module is joined by equality with each of its own prefixes, so there is no theta join.
    """
    tried = modules.select("module", F.explode(prefixes(F.col("module"))).alias("prefix"))
    hit = tried.join(contracts.select(F.col("name").alias("prefix")).distinct(), "prefix")
    best = hit.groupBy("module").agg(F.max_by("prefix", F.length("prefix")).alias("contract"))
    return modules.select("module").distinct().join(best, "module", "left")


def by_tier(offers: DataFrame) -> DataFrame:
    """One contract per name: the one of the lowest tier, then of the lowest place."""
    rest = [c for c in offers.columns if c != "name"]
    return offers.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct("tier", "place")).alias("c")).select("name", "c.*")


#: The fields that a contract and its parts may have.
FIELDS = {
    "$": ["schemaVersion", "package", "exports", "evidence"],
    "$.package": ["name", "version"],
    "$.evidence": ["kind"],
    "export": ["kind", "reactiveReads", "callbacks", "asyncBehavior"],
    "reactiveReads": ["kind", "path"],
    "callbacks": ["argument", "execution"],
}


def _strange(value: Column, allowed: list[str]) -> Column:
    """Whether an object (a variant) has a field that is not allowed; null and other values have none."""
    names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.exists(names, lambda n: ~n.isin(*allowed)), F.lit(False))


def _unknown_field(v: Column) -> Column:
    found = _strange(v, FIELDS["$"])
    for part in ("$.package", "$.evidence"):
        found = found | _strange(F.try_variant_get(v, part, "variant"), FIELDS[part])
    exports = F.map_values(F.try_variant_get(v, "$.exports", "map<string,variant>"))

    def strange_export(e: Column) -> Column:
        inside = lambda name: F.coalesce(F.exists(F.try_variant_get(e, f"$.{name}", "array<variant>"), lambda x: _strange(x, FIELDS[name])), F.lit(False))
        return _strange(e, FIELDS["export"]) | inside("reactiveReads") | inside("callbacks")

    return found | F.coalesce(F.exists(exports, strange_export), F.lit(False))


def decode(texts: DataFrame) -> DataFrame:
    """name, contract and problem of each JSON ``text``: problem says why it is refused, null if it is sound.

    Fields are closed: an unknown or repeated one makes a text no contract of this version.
    """
    read = texts.select("*", F.from_json("text", CONTRACT, {"mode": "PERMISSIVE"}).alias("c"), F.try_parse_json("text").alias("_v"))
    exports = F.map_values("c.exports")
    bad_kind = F.exists(exports, lambda e: ~F.coalesce(e["kind"].isin(*EXPORT_KINDS), F.lit(False)))
    bad_call = F.exists(exports, lambda e: F.exists(F.coalesce(e["callbacks"], F.array()), lambda b: ~F.coalesce(b["execution"].isin(*EXECUTIONS), F.lit(False)) | (b["argument"] < 0)))
    problem = (
        F.when(F.col("c").isNull() | F.col("_v").isNull() | F.col("c.schemaVersion").isNull(), "not a contract")
        .when(F.col("c.schemaVersion") != 1, "unknown version")
        .when(_unknown_field(F.col("_v")), "unknown field")
        .when(F.trim(F.coalesce("c.package.name", F.lit(""))) == "", "no name")
        .when(~F.coalesce(F.col("c.evidence.kind").isin(*EVIDENCE), F.lit(False)), "unknown evidence")
        .when(F.coalesce(bad_kind, F.lit(False)), "unknown kind of export")
        .when(F.coalesce(bad_call, F.lit(False)), "unknown callback")
    )
    return read.select("*", F.col("c.package.name").alias("name"), problem.alias("problem")).drop("_v")


def missing(imports: DataFrame, contracts: DataFrame) -> DataFrame:
    """Packages that are imported but have no contract: count and first place (by path, then start).

    ``imports`` has package, path and start_byte.
    """
    lost = imports.join(contracts.select(F.col("name").alias("package")).distinct(), "package", "left_anti")
    return lost.groupBy("package").agg(F.count(F.lit(1)).alias("n_imports"), F.min(F.struct("path", "start_byte")).alias("f")).select("package", "n_imports", F.col("f.path").alias("first_path"), F.col("f.start_byte").alias("first_start"))


def emit(summaries: DataFrame) -> DataFrame:
    """One JSON contract per package of ``summaries`` (package, version, export, kind, unresolved).

    A package with an unresolved export is refused: its text is null.
    """
    exports = F.map_from_entries(F.sort_array(F.collect_list(F.struct("export", F.struct("kind").alias("v")))))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.col("package").alias("name"), F.col("version")).alias("package"), F.col("exports"), F.struct(F.lit("generated").alias("kind")).alias("evidence"))
    grouped = summaries.groupBy("package", "version").agg(exports.alias("exports"), F.bool_or("unresolved").alias("refused"))
    return grouped.select("package", "version", F.when(~F.col("refused"), F.to_json(body)).alias("text"))
