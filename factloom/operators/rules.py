"""The rule catalogue and its evaluation into one findings relation.

Inputs are the derived streams of an analysis, one DataFrame each, with project_id, path,
start_byte, end_byte and what their rule looks at. A rule is a filter and a projection; all are united into
one schema, joined to the catalogue on (code, name), since codes are not unique, and made distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code, name, severity and whether the rule says that a proof is not possible.
CATALOGUE = [
    ("SC1001", "strict-read-untracked", "warning", False),
    ("SC1002", "reactive-read-after-await", "error", False),
    ("SC1003", "component-props-destructure", "error", False),
    ("SC1004", "component-returns-conditionally", "error", False),
    ("SC2001", "reactive-write-in-owned-scope", "error", False),
    ("SC2002", "action-called-in-owned-scope", "error", False),
    ("SC3001", "cleanup-in-forbidden-scope", "error", False),
    ("SC3002", "primitive-in-leaf-owner", "error", False),
    ("SC3003", "flush-in-forbidden-scope", "error", False),
    ("SC3004", "invalid-cleanup-return", "error", False),
    ("SC3005", "settled-cleanup-unowned", "error", False),
    ("SC4001", "no-owner-effect", "warning", False),
    ("SC4002", "no-owner-cleanup", "warning", False),
    ("SC4003", "no-owner-boundary", "warning", False),
    ("SC5001", "pending-async-untracked-read", "error", False),
    ("SC5002", "pending-async-forbidden-scope", "warning", False),
    ("SC5003", "async-outside-loading-boundary", "warning", False),
    ("SC6001", "primitive-in-directive-application", "error", False),
    ("SC7001", "missing-effect-function", "error", False),
    ("SC7002", "sync-node-received-async", "error", False),
    ("SC7003", "invalid-refresh-target", "error", False),
    ("SC7003", "invalid-affects-target", "error", False),
    ("SC7004", "affects-keys-on-accessor", "error", False),
    ("SC9001", "package-contract-export-missing", "error", True),
    ("SC9002", "cleanup-return-unresolved", "error", True),
    ("SC9003", "refresh-target-unresolved", "error", True),
    ("SC9003", "affects-target-unresolved", "error", True),
    ("SC9004", "execution-map-incomplete", "error", True),
    ("SC9005", "package-contract-missing", "error", True),
]

#: Execution roles, and those in which writes and actions are allowed.
ROLES = ["tracked", "untracked", "event", "deferred", "effect-apply", "directive-apply"]
WRITE_ROLES = ["event", "deferred", "effect-apply", "directive-apply"]

#: Bits of the ownership lattice.
OWNED, UNOWNED, LEAF = 1, 2, 4

AT = ["project_id", "path", "start_byte", "end_byte"]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "code string, rule string, severity string, uncertifiable boolean")


def _hit(df: DataFrame, code: Column, rule: Column, subject: Column, uncertain: Column | None = None) -> DataFrame:
    return df.select(*AT, code.alias("code"), rule.alias("rule"), subject.cast("string").alias("subject"), (F.lit(False) if uncertain is None else uncertain).alias("uncertain"))


def _named(df: DataFrame, name: Column, subject: Column, uncertain: Column | None = None) -> DataFrame:
    """Code of a rule by its name; rows with a null name are dropped."""
    codes = F.create_map(*[F.lit(x) for code, rule, _, _ in CATALOGUE for x in (rule, code)])
    return _hit(df.where(name.isNotNull()), codes[name], name, subject, uncertain)


def reads(df: DataFrame) -> DataFrame:
    """Reads that nothing tracks: needs role and subject."""
    return _named(df.where(F.col("role").isin("untracked", "effect-apply")), F.lit("strict-read-untracked"), F.col("subject"))


def writes(df: DataFrame) -> DataFrame:
    """Writes where none may start: needs role, subject, allowed_by_option."""
    return _named(df.where(~F.coalesce("allowed_by_option", F.lit(False)) & ~F.col("role").isin(*WRITE_ROLES)), F.lit("reactive-write-in-owned-scope"), F.col("subject"))


def actions(df: DataFrame) -> DataFrame:
    return _named(df.where(~F.col("role").isin(*WRITE_ROLES)), F.lit("action-called-in-owned-scope"), F.col("subject"))


def leaf_operations(df: DataFrame) -> DataFrame:
    """Operations inside leaf owners: needs primitive. A bag: one row per owner around an operation."""
    p = F.col("primitive")
    return _named(df, F.when(p == "onCleanup", "cleanup-in-forbidden-scope").when(p == "flush", "flush-in-forbidden-scope").otherwise("primitive-in-leaf-owner"), p)


def cleanup_returns(df: DataFrame) -> DataFrame:
    """Values returned where a cleanup is expected: needs status (invalid, unresolved or other) and subject."""
    return _named(df, F.when(F.col("status") == "invalid", "invalid-cleanup-return").when(F.col("status") == "unresolved", "cleanup-return-unresolved"), F.col("subject"))


def missing_owners(df: DataFrame) -> DataFrame:
    """Operations without an owner: needs operation, report, uncertain."""
    o = F.col("operation")
    name = F.when(o == "cleanup", "no-owner-cleanup").when(o == "boundary", "no-owner-boundary").when(o == "settled-cleanup", "settled-cleanup-unowned").otherwise("no-owner-effect")
    return _named(df.where("report"), name, o, F.coalesce("uncertain", F.lit(False)))


def async_reads(df: DataFrame) -> DataFrame:
    """Reads of pending values: needs leaf_owner, role, under_loading and subject."""
    name = (
        F.when(F.col("leaf_owner").isNotNull(), "pending-async-forbidden-scope")
        .when(F.col("role") == "untracked", "pending-async-untracked-read")
        .when((F.col("role") == "tracked") & ~F.coalesce("under_loading", F.lit(False)), "async-outside-loading-boundary")
    )
    return _named(df, name, F.col("subject"))


def creations(df: DataFrame) -> DataFrame:
    return _named(df, F.lit("primitive-in-directive-application"), F.col("primitive"))


def static_violations(df: DataFrame) -> DataFrame:
    """Ready violations: needs code, rule and subject. An identity outside the catalogue is an error."""
    known = F.create_map(*[F.lit(x) for code, rule, _, _ in CATALOGUE for x in (f"{code} {rule}", True)])
    identity = F.concat_ws(" ", "code", "rule")
    checked = F.when(known[identity], F.col("code")).otherwise(F.raise_error(F.concat(F.lit("unknown rule "), identity)).cast("string"))
    return _hit(df, checked, F.col("rule"), F.col("subject"))


STREAMS = {
    "reads": reads, "writes": writes, "actions": actions, "leaf_operations": leaf_operations, "cleanup_returns": cleanup_returns,
    "missing_owners": missing_owners, "async_reads": async_reads, "creations": creations, "static_violations": static_violations,
}


def findings(spark: SparkSession, streams: dict[str, DataFrame]) -> DataFrame:
    """All rules over their streams: location, code, rule, kind, severity and subject, each row once.

    An uncertain finding is uncertifiable and an error, whatever its rule. Rows carry no order; sort
    by project_id, path, start_byte, code and subject to show them.
    """
    hits = reduce(DataFrame.unionByName, [STREAMS[name](df) for name, df in streams.items()])
    rules = F.broadcast(catalogue(spark).select(F.col("code").alias("c_code"), F.col("rule").alias("c_rule"), "severity", "uncertifiable"))  # 29 rows
    joined = hits.join(rules, (F.col("code") == F.col("c_code")) & (F.col("rule") == F.col("c_rule")))
    return joined.select(
        *AT,
        "code",
        "rule",
        F.when(F.col("uncertain") | F.col("uncertifiable"), "uncertifiable").otherwise("violation").alias("kind"),
        F.when(F.col("uncertain"), "error").otherwise(F.col("severity")).alias("severity"),
        "subject",
    ).distinct()


def status(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """violation if any, else uncertifiable if any, else certified; no findings are certified."""
    violation, open_ = F.bool_or(F.col("kind") == "violation"), F.bool_or(F.col("kind") == "uncertifiable")
    word = F.when(violation, "violation").when(open_, "uncertifiable").otherwise("certified").alias("status")
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}s") for s in ("error", "warning")]
    return (found.groupBy(*by) if by else found.groupBy()).agg(word, *counts)


def obligations(found: DataFrame) -> DataFrame:
    """Distinct (rule, location) per project."""
    return found.select("project_id", "rule", "path", "start_byte", "end_byte").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("n_obligations"))


def execution_role(in_effect_apply: Column, in_allowed: Column, in_tracked: Column, in_tracked_argument: Column, callback: Column) -> Column:
    """The role of a point: the first of these that holds decides; a callback is named by its kind."""
    return (
        F.when(in_effect_apply, "effect-apply")
        .when(in_allowed, "deferred")
        .when(in_tracked | in_tracked_argument, "tracked")
        .when(callback == "event-handler", "event")
        .when(callback == "deferred", "deferred")
        .when(callback == "directive-apply", "directive-apply")
        .otherwise("untracked")
    )


def async_role(role: Column, in_markup: Column) -> Column:
    """For pending reads a deferred callback inside markup counts as tracked."""
    return F.when((role == "deferred") & in_markup, "tracked").otherwise(role)


def execution_name(role: Column) -> Column:
    """What a contract calls an execution role: tracked, deferred, or inline for all others."""
    return F.when(role.isin("tracked", "deferred"), role).otherwise("inline")
