"""Readers with strict or diagnostic validation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paths import plain_path
from factloom.functions.text import text_hash

SPAN = "start bigint, `end` bigint"
#: The execution map that a compiler gives for one file.
EXECUTION_MAP = f"""compilerFactsProtocol int, sourceHash string,
trackedRegions array<struct<{SPAN}, reason string>>, untrackedRegions array<struct<{SPAN}, reason string>>,
ownershipRegions array<struct<{SPAN}, kind string>>, callbackRoles array<struct<{SPAN}, role string>>, jsxOperations array<struct<{SPAN}, kind string>>"""
PROTOCOL = 1


def hashed_sources(files: DataFrame) -> DataFrame:
    """path (plain), source and its hash; with a ``sha256`` column, also whether it agrees."""
    out = files.withColumn("path", plain_path(F.col("path"))).withColumn("actual", text_hash(F.col("source")))
    return out.withColumn("agrees", F.col("sha256").eqNullSafe(F.col("actual"))) if "sha256" in files.columns else out


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def _decoded(raw: DataFrame) -> DataFrame:
    return hashed_sources(raw.select("path", F.decode("content", "UTF-8").alias("source"), F.col("modificationTime").alias("stamp")))


def read_sources(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as path, source, stamp and hash; bytes that are not UTF-8 become replacement characters."""
    return _decoded(_listed(spark, folder, pattern))


def changed_files(known: DataFrame, spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of ``folder`` that are new to ``known`` (path, stamp, actual), or whose stamp moved and whose hash differs.

    Stamps are compared on the listing, which reads no content; only files that moved are read and hashed. Their
    names pass the driver, as the listing of every file does when a folder is read.
    """
    k = known.select(F.col("path").alias("k_path"), F.col("stamp").alias("k_stamp"), F.col("actual").alias("k_hash"))
    listed = _listed(spark, folder, pattern).select(F.col("path").alias("place"), plain_path(F.col("path")).alias("l_path"), F.col("modificationTime").alias("l_stamp"))
    moved = listed.join(k, F.col("l_path") == F.col("k_path"), "left").where("k_path is null or l_stamp <> k_stamp")
    places = [r.place for r in moved.select("place").toLocalIterator()]
    if not places:
        return read_sources(spark, folder, pattern).limit(0)
    read = _decoded(spark.read.format("binaryFile").load(places))
    return read.join(k, F.col("path") == F.col("k_path"), "left").where("k_hash is null or actual <> k_hash").drop("k_path", "k_stamp", "k_hash")


def _outside(spans: Column, size: Column) -> Column:
    return F.exists(F.coalesce(spans, F.array()), lambda s: (s["start"] < 0) | (s["start"] > s["end"]) | (s["end"] > size))


def _unsorted(spans: Column) -> Column:
    pairs = F.transform(spans, lambda s: F.struct(s["start"], s["end"]))
    return F.coalesce(pairs != F.array_sort(pairs), F.lit(False))


def execution_maps(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Decode ``map_json`` beside ``source``: the map and a problem, null where it is sound; strict raises instead."""
    m = texts.select("*", F.from_json("map_json", EXECUTION_MAP).alias("m"))
    size = F.octet_length("source")
    groups = ["trackedRegions", "untrackedRegions", "ownershipRegions", "callbackRoles", "jsxOperations"]
    problem = F.when(F.col("m").isNull() | F.col("m.compilerFactsProtocol").isNull(), "not a map").when(F.col("m.compilerFactsProtocol") != PROTOCOL, "protocol")
    problem = problem.when(~F.col("m.sourceHash").eqNullSafe(text_hash(F.col("source"))), "source hash")
    for g in groups:
        problem = problem.when(_outside(F.col(f"m.{g}"), size), f"{g} outside").when(_unsorted(F.col(f"m.{g}")), f"{g} unsorted")
    for g in ("ownershipRegions", "jsxOperations"):
        problem = problem.when(F.exists(F.coalesce(F.col(f"m.{g}"), F.array()), lambda s: F.trim(F.coalesce(s["kind"], F.lit(""))) == ""), f"{g} without kind")
    out = m.withColumn("problem", problem)
    return out.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("execution map: "), "problem")).cast("boolean")).otherwise(True)) if strict else out


def regions(maps: DataFrame, keys: list[str]) -> DataFrame:
    """All spans of sound execution maps as rows: keys, group, start, end and label."""
    sound = maps.where("problem is null")
    parts = []
    for g, label in (("trackedRegions", "reason"), ("untrackedRegions", "reason"), ("ownershipRegions", "kind"), ("callbackRoles", "role"), ("jsxOperations", "kind")):
        parts.append(F.transform(F.coalesce(F.col(f"m.{g}"), F.array()), lambda s, g=g, label=label: F.struct(F.lit(g).alias("group"), s["start"].alias("start"), s["end"].alias("end"), s[label].alias("label"))))
    return sound.select(*keys, F.explode(F.concat(*parts)).alias("r")).select(*keys, "r.*")


def demanded(facts: DataFrame, demands: DataFrame, keys: list[str]) -> DataFrame:
    """Only the facts that are asked for: a semi-join, so unasked ones are not shuffled further."""
    return facts.join(demands.select(*keys).distinct(), keys, "left_semi")


def markup_elements(texts: DataFrame, ident: str) -> DataFrame:
    """Elements of the markup in ``text``: ident, name, start_byte, n_attributes, closing; null texts have none."""
    schema = f"`{ident}` {dict(texts.dtypes)[ident]}, name string, start_byte bigint, n_attributes int, closing boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        class Collect(HTMLParser):
            def __init__(self, text: str):
                super().__init__(convert_charrefs=True)
                self.found: list[tuple] = []
                self.lines = [0]
                for line in text.split("\n"):
                    self.lines.append(self.lines[-1] + len(line) + 1)
                self.text, self.chars, self.bytes = text, 0, 0
                self.feed(text)

            def _at(self) -> int:
                """The byte offset of a tag: what lies between it and the last one is added, as tags come in order."""
                line, column = self.getpos()
                at = self.lines[line - 1] + column
                self.bytes += len(self.text[self.chars : at].encode())
                self.chars = at
                return self.bytes

            def handle_starttag(self, tag, attrs):
                self.found.append((tag, self._at(), len(attrs), False))

            def handle_endtag(self, tag):
                self.found.append((tag, self._at(), 0, True))

        for batch in batches:
            rows = []
            for key, text in zip(batch[ident], batch["text"]):
                if isinstance(text, str) and "<" in text:
                    rows += [(key, *x) for x in Collect(text).found]
            yield pd.DataFrame(rows, columns=[ident, "name", "start_byte", "n_attributes", "closing"])

    return texts.select(ident, "text").mapInPandas(run, schema)
