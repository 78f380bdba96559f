"""Parent-child links to full hierarchies by tree contraction.

Every node has at most one parent. A round of contraction removes leaves (rake) and, of the
nodes with exactly one child, those whose hash in this round is above that of their parent and of their child
(compress: no two of them are neighbours, so the child below each is linked to the node above
it), and records what it removed together with the node it hung from. The
number of nodes falls by a constant share each round, so a chain of n links takes O(log n) rounds. What never goes away is a self-loop: the core of a cycle. The
records are then reversed, last round first: a removed node gets root, depth and
path from the node it hung from. Each round is one job over what is left, cut
off by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom.session import materialize, scratch_path


def contract(edges: DataFrame, folder: str, with_paths: bool = False) -> list[int]:
    """Contract ``edges`` (child, parent; child unique) into ``folder``; gives the number of records of each round, then of what is left.

    ``folder/round=R`` holds child, parent, steps, via and kind: ``rake`` and ``splice`` rows are the
    records of round R, ``keep`` rows the edges left after it. via lists the nodes
    passed from child (included) to parent (excluded) if paths are asked for.
    """
    # Text expressions keep the rounds' code equal (the round is a column), so it is compiled once.
    via = "array(child)" if with_paths else "cast(null as array<bigint>)"
    chain = "concat({0}, {1})" if with_paths else "{0}"
    left = edges.selectExpr("child", "parent", "1L as steps", f"{via} as via", "1 as r")
    counts: list[int] = []
    while True:
        degree = left.groupBy(F.expr("parent as d_node")).agg(F.expr("count(1) as children"), F.expr("max(child) as only_child"))
        unary = "children = 1 and only_child <> child and child <> parent"
        top = "xxhash64(child, r) > xxhash64(parent, r) and xxhash64(child, r) > xxhash64(only_child, r)"
        known = left.join(degree, F.expr("child = d_node"), "left").selectExpr("child", "parent", "steps", "via", "r", f"coalesce({unary} and {top}, false) as spliced", "children is null as leaf")
        spliced = known.where("spliced").selectExpr("child as m_node", "parent as m_up", "steps as m_steps", "via as m_via")
        linked = known.join(spliced, F.expr("parent = m_node"), "left").selectExpr(
            "child",
            "coalesce(m_up, parent) as parent",
            "steps + coalesce(m_steps, 0) as steps",
            f"case when m_node is not null then {chain.format('via', 'm_via')} else via end as via",
            "r + 1 as r",
            "case when leaf then 'rake' when spliced then 'splice' else 'keep' end as kind",
        )
        seen = Observation()
        measures = [F.expr("count_if(kind = 'keep' and child <> parent) as open"), F.expr("count_if(kind = 'keep') as kept"), F.expr("count(1) as every")]
        done = materialize(linked.observe(seen, *measures), f"{folder}/round={len(counts) + 1}")
        got = seen.get
        counts.append(got["every"] - got["kept"])
        if got["open"] == 0:
            return [*counts, got["kept"]]
        left = done.where("kind = 'keep'").drop("kind")


def expand(edges: DataFrame, folder: str, counts: list[int], with_paths: bool = False) -> DataFrame:
    """Reverse the records: node, root, depth, endless and path for every child of ``edges``.

    A node of a cycle, or leading into one, is endless: root and depth are null and the
    path holds the nodes up to the core of the cycle.
    """
    spark, rounds = edges.sparkSession, len(counts) - 1
    schema = "node bigint, root bigint, depth bigint, endless boolean, path array<bigint>"
    record = "child bigint, parent bigint, steps bigint, via array<bigint>, r int, kind string"
    read = lambda r: spark.read.schema(record).parquet(f"{folder}/round={r}")
    core = read(rounds).where("kind = 'keep'").selectExpr("child as node", "cast(null as bigint) as root", "cast(null as bigint) as depth", "true as endless", "via as path")
    core.write.mode("overwrite").parquet(f"{folder}/solved/r={rounds + 1}")
    path = "concat(via, coalesce(a_path, array(parent)))" if with_paths else "cast(null as array<bigint>)"
    for r in range(rounds, 0, -1):
        solved = spark.read.schema(schema).parquet(*[f"{folder}/solved/r={k}" for k in range(r + 1, rounds + 2)])
        above = solved.selectExpr("node as a_node", "root as a_root", "depth as a_depth", "coalesce(endless, false) as a_endless", "path as a_path")
        out = read(r).where("kind <> 'keep'").join(above, F.expr("parent = a_node"), "left").selectExpr(
            "child as node",
            "case when not coalesce(a_endless, false) then coalesce(a_root, parent) end as root",
            "case when not coalesce(a_endless, false) then steps + coalesce(a_depth, 0) end as depth",
            "coalesce(a_endless, false) as endless",
            f"{path} as path",
        )
        out.write.mode("overwrite").parquet(f"{folder}/solved/r={r}")
    return spark.read.schema(schema).parquet(*[f"{folder}/solved/r={k}" for k in range(1, rounds + 2)])


def hierarchy(nodes: DataFrame, edges: DataFrame, with_paths: bool = True) -> DataFrame:
    """node, root, depth, endless and path (from node to root) of every node.

    ``nodes`` has unique bigint node; ``edges`` has child, parent, both among the nodes, child unique.
    A node without parent is its own root at depth 0. Empty tables give no rows.
    """
    spark = nodes.sparkSession
    folder = scratch_path(spark, "contract")
    edges = materialize(edges.select("child", "parent"), f"{folder}/edges")
    counts = contract(edges, folder, with_paths)
    hung = expand(edges, folder, counts, with_paths).select(F.col("node").alias("h_node"), "root", "depth", "endless", "path")
    alone = F.col("h_node").isNull()
    return nodes.select("node").join(hung, F.col("node") == F.col("h_node"), "left").select(
        "node",
        F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"),
        F.when(alone, F.lit(0)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        F.coalesce("endless", F.lit(False)).alias("endless"),
        F.when(alone, F.array("node")).otherwise(F.col("path")).alias("path"),
    )


def endless_nodes(edges: DataFrame) -> DataFrame:
    """Only the nodes on or leading into cycles: the same contraction, and of its reversal only what hangs from cores."""
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "contract")
    rounds = len(contract(materialize(edges.select("child", "parent"), f"{folder}/edges"), folder)) - 1
    record = "child bigint, parent bigint, steps bigint, via array<bigint>, r int, kind string"
    read = lambda r: spark.read.schema(record).parquet(f"{folder}/round={r}")
    seen = Observation()
    read(rounds).where("kind = 'keep'").select("child").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/endless/r={rounds + 1}")
    found = range(rounds, 0, -1) if seen.get["n"] else []
    for r in found:  # without a core nothing is endless
        above = spark.read.schema("child bigint").parquet(*[f"{folder}/endless/r={k}" for k in range(r + 1, rounds + 2)]).selectExpr("child as a_node")
        read(r).where("kind <> 'keep'").join(above, F.expr("parent = a_node"), "left_semi").select("child").write.parquet(f"{folder}/endless/r={r}")
    every = [f"{folder}/endless/r={k}" for k in range(1 if found else rounds + 1, rounds + 2)]
    return spark.read.schema("child bigint").parquet(*every).selectExpr("child as node")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node of :func:`hierarchy` and each node above it; endless chains have none."""
    return (
        tree.where("not endless")
        .select(F.col("node").alias("descendant"), F.posexplode("path").alias("distance", "ancestor"))
        .where("distance > 0")
        .select("ancestor", "descendant", "distance")
    )


def current_symbols(symbols: DataFrame) -> DataFrame:
    """Current rows: per project_id and id the one recorded last, unless it has a deleted_at.

    Rows recorded at once count by the greatest row_id; a null recorded_at is the earliest. row_id
    is unique but for repeats and so identifies the current symbol.
    """
    last = F.max(
        F.struct(
            F.coalesce("recorded_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
            F.col("row_id"),
            F.col("deleted_at").isNotNull().alias("gone"),
            F.col("alias_target"),
        )
    ).alias("last")
    return (
        symbols.where("id is not null")
        .groupBy("project_id", "id")
        .agg(last)
        .where("not last.gone")
        .select("project_id", "id", F.col("last.row_id").alias("node"), F.nullif(F.col("last.alias_target"), F.lit("")).alias("alias_target"))
    )


def alias_edges(current: DataFrame) -> DataFrame:
    """(child, parent) between current symbols of one project; a target that is not current ends the chain."""
    target = current.select(F.col("project_id").alias("t_project"), F.col("id").alias("t_id"), F.col("node").alias("parent"))
    return current.where("alias_target is not null").join(
        target, F.col("project_id").eqNullSafe(F.col("t_project")) & (F.col("alias_target") == F.col("t_id"))
    ).select(F.col("node").alias("child"), "parent")
