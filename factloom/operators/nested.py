"""Deeply nested records as flat tables with Merkle identities.

Every child object gets an identity: the SHA-256 of its kind, its own canonical
fields and its children's identities in order, so hashes are made from the bottom
up. ``objects`` stores an identity once, whatever the number of places it stands
in; ``bridges`` keeps every occurrence with its record, parent and ordinals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(kind: str, body: Column, children: Column | None = None) -> Column:
    """SHA-256 over kind, canonical body and the identities of the children, in order."""
    parts = [F.lit(kind), F.coalesce(body, F.lit("null"))]
    if children is not None:
        parts.append(F.coalesce(F.array_join(children, ","), F.lit("")))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _elements(value: Column) -> Column:
    """The object elements of a JSON value, others null; a lone object counts as an array of it."""
    an_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    listed = F.try_variant_get(value, "$", "array<variant>")
    several = F.transform(listed, lambda e: F.when(an_object(e), e))
    return F.when(an_object(value), F.array(value)).otherwise(several)


def _canonical(value: Column) -> Column:
    """JSON text of a variant: fields in order of name, no layout."""
    return F.to_json(value)


#: Closes the array that a payload is parsed in, so that text after its JSON value makes it invalid.
_END = "end of payload"


def parse_object(payload: Column) -> Column:
    """The payload as a variant, if its whole text is one JSON object; else null. Of a repeated name the last counts."""
    both = F.try_parse_json(F.concat(F.lit("["), payload, F.lit(f',"{_END}"]')))
    whole = F.try_variant_get(both, "$[1]", "string").eqNullSafe(F.lit(_END))
    value = F.try_variant_get(both, "$[0]", "variant")
    return F.when(whole & F.schema_of_variant(value).startswith("OBJECT"), value)


def _occurrence(kind: str, pos_1: Column, pos_2: Column, made: Column, parent: Column | None) -> Column:
    row = F.struct(
        F.lit(kind).alias("child"),
        pos_1.cast("int").alias("pos_1"),
        pos_2.cast("int").alias("pos_2"),
        made["id"].alias("id"),
        (F.lit(None).cast("string") if parent is None else parent).alias("parent_id"),
        made["body"].alias("body"),
    )
    return F.when(made.isNotNull(), row)


def _listed(kind: str, made: Column, inner_kind: str | None = None) -> Column:
    """All occurrences in one record's array of identified objects, inner ones too; null elements keep their position but give none."""
    outer = F.transform(made, lambda e, i: _occurrence(kind, i, F.lit(-1), e, None))
    every = [outer]
    if inner_kind:
        every.append(F.flatten(F.transform(made, lambda e, i: F.coalesce(F.transform(e["children"], lambda c, j: _occurrence(inner_kind, i, j, c, e["id"])), F.array()))))
    some = [F.filter(F.coalesce(x, F.array()), lambda o: o.isNotNull()) for x in every]
    return F.concat(*some)


def _leaf(kind: str, body: Column, there: Column) -> Column:
    return F.when(there.isNotNull(), F.struct(identity(kind, body).alias("id"), body.alias("body")))


def _node(kind: str, own: Column, children: Column, there: Column) -> Column:
    ids = F.transform(children, lambda c: F.coalesce(c["id"], F.lit("null")))
    return F.when(there.isNotNull(), F.struct(identity(kind, own, ids).alias("id"), own.alias("body"), children.alias("children")))


def finding_occurrences(findings: DataFrame) -> DataFrame:
    """One row per evidence, fix and edit object of a finding.

    A record delivered twice counts once; null arrays and null elements give no row.
    """

    def fix(f: Column) -> Column:
        edits = F.transform(f["edits"], lambda e: _leaf("edit", F.to_json(e), e))
        return _node("fix", F.to_json(F.struct(f["message"].alias("message"), f["applicability"].alias("applicability"))), edits, f)

    made = (
        findings.select("record_id", "evidence", "fixes")
        .where("size(evidence) > 0 or size(fixes) > 0")
        .dropDuplicates(["record_id"])
        .select("record_id", F.transform("evidence", lambda e: _leaf("evidence", F.to_json(e), e)).alias("evidence"), F.transform("fixes", fix).alias("fix"))
    )
    every = F.concat(_listed("evidence", F.col("evidence")), _listed("fix", F.col("fix"), "edit"))
    return made.select("record_id", F.explode(every).alias("o")).select("record_id", "o.*")


def file_fact_occurrences(file_facts: DataFrame) -> DataFrame:
    """One row per call, call argument, async function and call after await of a payload.

    A payload that is null, does not parse or is no object gives no rows.
    """
    file_facts.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def outer(kind: str, field: str, inner_kind: str, inner_field: str) -> Column:
        def one(e: Column) -> Column:
            inner = _elements(F.try_variant_get(e, f"$.{inner_field}", "variant"))
            children = F.transform(inner, lambda c: _leaf(inner_kind, _canonical(c), c))
            own = F.to_json(F.map_filter(F.try_variant_get(e, "$", "map<string,variant>"), lambda k, _: k != inner_field))
            return _node(kind, own, children, e)

        return F.transform(_elements(F.try_variant_get(F.col("v"), f"$.{field}", "variant")), one).alias(kind)

    made = (
        file_facts.select("record_id", "payload")
        .where("payload is not null")
        .dropDuplicates(["record_id"])
        .select("record_id", parse_object(F.col("payload")).alias("v"))
        .where("v is not null")
        .select("record_id", outer("call", "calls", "call_argument", "arguments"), outer("async_function", "asyncFunctions", "call_after_await", "callsAfterAwait"))
    )
    every = F.concat(_listed("call", F.col("call"), "call_argument"), _listed("async_function", F.col("async_function"), "call_after_await"))
    return made.select("record_id", F.explode(every).alias("o")).select("record_id", "o.*")


def occurrences(findings: DataFrame, file_facts: DataFrame) -> DataFrame:
    """Every child object of both tables: child, record_id, pos_1, pos_2, id, parent_id, body."""
    return finding_occurrences(findings).unionByName(file_fact_occurrences(file_facts))


def bridges(seen: DataFrame) -> DataFrame:
    """Parent-child bridge rows: one per occurrence, no bodies."""
    return seen.select("child", "record_id", "pos_1", "pos_2", "id", "parent_id")


def objects(seen: DataFrame) -> DataFrame:
    """Each identity once, with its body and the number of its occurrences."""
    return seen.groupBy("child", "id").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("n_occurrences"))
