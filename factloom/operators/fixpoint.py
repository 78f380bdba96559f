"""Recursive operators as loops over DataFrames.

Each round joins what is new with the edges, drops what is known, and is written to a
table in the shared folder, so plans stay short and lost executors cost one round. Loops
end when nothing is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom.session import materialize, scratch_path, tidy_at_times


def _write(df: DataFrame, path: str, measure: F.Column) -> int:
    seen = Observation()
    df.observe(seen, measure.alias("n")).write.mode("overwrite").parquet(path)
    tidy_at_times(df.sparkSession)
    return seen.get["n"]


def _bounded(r: int, most_rounds: int | None) -> None:
    """Fails where a bound is given and met: an unfinished closure is no result."""
    if most_rounds is not None and r >= most_rounds:
        raise RuntimeError(f"rows are still new after {r} rounds")


def roots_by_doubling(edges: DataFrame) -> DataFrame:
    """(node, root, hops) for each child of ``edges`` (child, parent; child unique), by pointer doubling.

    After r rounds a pointer spans 2^r edges, so chains of n links take log2 n rounds. Nodes that have reached
    their root are written away and only looked up from then on; only moving ones are written again. A round in which no node arrives
    proves that none ever will, for the nodes of a chain stand at all distances below its longest: the loop needs no bound, and
    a node whose chain never ends has a null root. Empty edges give no rows.
    """
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "roots")
    types = dict(edges.dtypes)
    schema = f"node {types['child']}, up {types['parent']}, hops bigint"
    present: dict[tuple[int, bool], int] = {}

    def read(rounds, done: bool) -> DataFrame:
        parts = [f"{folder}/r={k}/done={str(done).lower()}" for k in rounds if present[k, done]]
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    def keep(df: DataFrame, r: int) -> None:
        seen = Observation()
        df.observe(seen, F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("moving")).write.partitionBy("done").parquet(f"{folder}/r={r}")
        tidy_at_times(spark)
        present[r, True], present[r, False] = seen.get["done"], seen.get["moving"]

    children = edges.select(F.col("child").alias("c_node"))
    first = edges.join(children, F.col("parent") == F.col("c_node"), "left")
    keep(first.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("hops"), F.col("c_node").isNull().alias("done")), 0)
    r, before = 0, None
    while present[r, False] and present[r, False] != before:
        before = present[r, False]
        moving = read([r], False)
        there = moving.withColumn("a_done", F.lit(False)).unionByName(read(range(r + 1), True).withColumn("a_done", F.lit(True)))
        above = there.select(F.col("node").alias("a_node"), F.col("up").alias("a_up"), F.col("hops").alias("a_hops"), "a_done")
        met = moving.join(above, F.col("up") == F.col("a_node"))
        keep(met.select("node", F.col("a_up").alias("up"), (F.col("hops") + F.col("a_hops")).alias("hops"), F.col("a_done").alias("done")), r + 1)
        r += 1
    ended = read(range(r + 1), True).select("node", F.col("up").alias("root"), "hops")
    endless = read([r], False).select("node", F.lit(None).cast(ended.schema["root"].dataType).alias("root"), F.lit(None).cast("bigint").alias("hops"))
    return ended.unionByName(endless)


def spread(seeds: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """All (node, tag) reachable from ``seeds`` (node, tag) along ``edges`` (src, dst): a semi-naive closure.

    Goes on until nothing is new; fails if ``most_rounds`` is given and rows are still new after them.
    """
    spark, folder = seeds.sparkSession, scratch_path(seeds.sparkSession, "spread")
    steps = materialize(edges.select("src", "dst").distinct(), f"{folder}/edges")
    schema = seeds.select("node", "tag").schema
    new = _write(seeds.select("node", "tag").distinct(), f"{folder}/known/r=0", F.count(F.lit(1)))
    r = 0
    while new:
        _bounded(r, most_rounds)
        known = spark.read.schema(schema).parquet(*[f"{folder}/known/r={k}" for k in range(r + 1)])
        front = spark.read.schema(schema).parquet(f"{folder}/known/r={r}")
        reached = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "tag").distinct()
        r += 1
        new = _write(reached.join(known, ["node", "tag"], "left_anti"), f"{folder}/known/r={r}", F.count(F.lit(1)))
    return spark.read.schema(schema).parquet(*[f"{folder}/known/r={k}" for k in range(r + 1)])


def first_wins(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, tag) for all nodes reachable from ``seeds`` (node, tag) along ``edges`` (src, dst, ord), one tag each: the one that arrives first.

    Fewer steps come first, then the lower ord, then the lower tag; a seed keeps its lowest tag. Goes on until nothing is new.
    """
    spark, folder = seeds.sparkSession, scratch_path(seeds.sparkSession, "first")
    steps = materialize(edges.select("src", "dst", "ord"), f"{folder}/edges")
    start = seeds.groupBy("node").agg(F.min("tag").alias("tag"))
    schema, r = start.schema, 0
    read = lambda rounds: spark.read.schema(schema).parquet(*[f"{folder}/known/r={k}" for k in rounds])
    new = _write(start, f"{folder}/known/r=0", F.count(F.lit(1)))
    while new:
        met = read([r]).join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min_by("tag", F.struct("ord", "tag")).alias("tag"))
        new = _write(met.join(read(range(r + 1)), "node", "left_anti"), f"{folder}/known/r={r + 1}", F.count(F.lit(1)))
        r += 1
    return read(range(r + 1))


def path_counts(roots: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, n_paths): the number of paths from each root, on acyclic edges; of up to ``depth`` edges if that is given.

    Counts are added up per round, so the work follows the pairs, not the paths. Cycles are an error where no depth is given: a path
    longer than there are edges proves one.
    """
    spark, folder = roots.sparkSession, scratch_path(roots.sparkSession, "paths")
    n_edges = _write(edges.select("src", "dst"), f"{folder}/edges", F.count(F.lit(1)))
    steps = spark.read.parquet(f"{folder}/edges")
    start = roots.select(F.col("node").alias("root"), "node", F.lit(1).cast("bigint").alias("n"))
    schema = start.schema
    new, r = _write(start, f"{folder}/level/r=0", F.count(F.lit(1))), 0
    while new and (depth is None or r < depth):
        if r > n_edges:
            raise RuntimeError("the edges have a cycle")
        front = spark.read.schema(schema).parquet(f"{folder}/level/r={r}")
        r += 1
        nxt = front.join(steps, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("n").alias("n"))
        new = _write(nxt.select("root", "node", "n"), f"{folder}/level/r={r}", F.count(F.lit(1)))
    every = spark.read.schema(schema).parquet(*[f"{folder}/level/r={k}" for k in range(r + 1)])
    return every.groupBy("root", "node").agg(F.sum("n").alias("n_paths"))


def lattice(seeds: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, context): the least fixpoint of bit sets along labelled edges.

    ``seeds`` has node and context; ``edges`` has src, dst and sets: null to pass the source's context
    on, else the bits to give. An edge fires only from a source with a context. Only nodes whose
    context grew fire again, and only they are written: contexts only gain bits, so a node's is the union of its rows. Goes on until none grows; fails if ``most_rounds`` is given and some still do after them.
    """
    spark, folder = seeds.sparkSession, scratch_path(seeds.sparkSession, "lattice")
    steps = materialize(edges.select("src", "dst", F.col("sets").cast("int").alias("sets")), f"{folder}/edges")
    schema = seeds.select("node", F.col("context").cast("int")).schema
    start = seeds.groupBy("node").agg(F.bit_or(F.col("context").cast("int")).alias("context")).where("context <> 0")
    new, r = _write(start, f"{folder}/grown/r=0", F.count(F.lit(1))), 0
    read = lambda rounds: spark.read.schema(schema).parquet(*[f"{folder}/grown/r={k}" for k in rounds])
    while new:
        _bounded(r, most_rounds)
        sent = read([r]).join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.coalesce("sets", "context").alias("got"))
        sent = sent.groupBy("node").agg(F.bit_or("got").alias("got")).where("got <> 0")
        had = read(range(r + 1)).groupBy(F.col("node").alias("h_node")).agg(F.bit_or("context").alias("had"))
        more = sent.join(had, F.col("node") == F.col("h_node"), "left").select("node", F.coalesce("had", F.lit(0)).alias("had"), F.coalesce("had", F.lit(0)).bitwiseOR(F.col("got")).alias("context"))
        r += 1
        new = _write(more.where("context <> had").select("node", "context"), f"{folder}/grown/r={r}", F.count(F.lit(1)))
    return read(range(r + 1)).groupBy("node").agg(F.bit_or("context").alias("context"))
