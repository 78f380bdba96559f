"""Mixing sources to target weights.

Documents fall into permuted blocks by a hash of their id. Token sums per block are all
the driver sees: at most sources times BLOCKS rows a level, whatever the corpus. From them it
sets the quota of each source; the block in which a quota ends is split into blocks again, until
what is left to cut is a few documents. A splitting tree divides the blocks of all
sources among the output shards: each node draws the left half's block counts from the
multivariate hypergeometric law, so every shard is an unbiased sample of the
mixture and the counts add up exactly. Each shard then gets disjoint slices of a
permutation of every source's blocks. Documents join their blocks' places and get a key
to shuffle by inside the shard.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.tokens import TOKENIZERS, token_counts
from factloom.session import materialize, scratch_path

#: Blocks per source, and per block that is split again.
BLOCKS = 256

#: A block of so many documents is cut by their order, which is one task's work; a larger one is split again.
CUT_ROWS = 2_000

#: Tokens of one output shard, about, and the least number of shards.
SHARD_TOKENS = 100_000_000
LEAST_SHARDS = 16


class Quota(NamedTuple):
    source: str
    target_share: float
    max_repeats: int
    available: int
    quota: int


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> list[Quota]:
    """Tokens that each source gives to a mixture of ``total`` tokens.

    Each source gets its share, but at most max_repeats times what it has; what such sources can't
    give is spread over the others in proportion to their shares, so that the shares of the
    whole keep the targets' proportions wherever repetition allows. total is by default all tokens
    of the sources with a target, once. Null or negative shares count as 0, null max_repeats as 1.
    """
    rows = [(s, max(0.0, w or 0.0), max(0, 1 if r is None else r)) for s, w, r in targets]
    cap = {s: available.get(s, 0) * r for s, _, r in rows}
    left = float(sum(available.get(s, 0) for s, _, _ in rows) if total is None else total)
    got = {s: 0.0 for s, _, _ in rows}
    open_ = [(s, w) for s, w, _ in rows if w > 0]
    while open_ and left > 0:
        weight = sum(w for _, w in open_)
        full = [(s, w) for s, w in open_ if cap[s] <= left * w / weight]
        if not full:
            for s, w in open_:
                got[s] = left * w / weight
            break
        for s, _ in full:
            got[s] = float(cap[s])
            left -= cap[s]
        open_ = [x for x in open_ if x not in full]
    return [Quota(s, w, r, available.get(s, 0), int(got[s])) for s, w, r in rows]


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: a binary tree of multivariate hypergeometric draws."""
    if shards == 1:
        return counts[None, :]
    half = shards // 2
    left = rng.multivariate_hypergeometric(counts, int(counts.sum()) * half // shards, method="marginals")
    return np.concatenate([split(left, half, rng), split(counts - left, shards - half, rng)])


PLACES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("copy", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        #: Tokens to take from the block; null for all.
        T.StructField("take", T.LongType()),
    ]
)


def places(plan: list[Quota], blocks: dict[str, dict[int, int]], shards: int, seed: int) -> list[tuple]:
    """(source, block, copy, shard, take) for every block drawn; the last block of a source may be cut."""
    rng = np.random.default_rng(seed)
    drawn: list[list[tuple]] = []
    for q in plan:
        own, mine, left = blocks.get(q.source, {}), [], q.quota
        for copy in range(q.max_repeats):
            order = sorted(own) if copy == 0 else list(own)
            for b in rng.permutation(order) if own else []:
                if left <= 0:
                    break
                mine.append((q.source, int(b), copy, None if own[b] <= left else left))
                left -= own[b]
        drawn.append([mine[i] for i in rng.permutation(len(mine))])
    counts = split(np.array([len(m) for m in drawn], dtype=np.int64), shards, rng)
    out = []
    for k, mine in enumerate(drawn):
        shard_of = np.repeat(np.arange(shards), counts[:, k])
        out += [(s, b, c, int(shard), take) for (s, b, c, take), shard in zip(mine, shard_of)]
    return out


def _finish(sized: DataFrame, cuts: list[tuple], blocks: int, seed: int, folder: str) -> DataFrame:
    """Rows of the blocks in which a quota ends: (source, block, copy, shard, take) each, cut to about ``take`` tokens.

    A block is split by another hash into permuted parts; whole parts are taken until the quota ends inside one, and that part is
    split in its turn. The last few documents are taken in the order of a hash, each as far as more than half of it is wanted.
    """
    spark, out, level = sized.sparkSession, [], 0
    part = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n + 1), "doc_id"), F.lit(blocks)).cast("int")
    open_ = sized.join(spark.createDataFrame(cuts, PLACES), ["source", "block"])
    rng = np.random.default_rng(seed + 1)
    while True:
        open_ = materialize(open_.withColumn("part", part(level)), f"{folder}/level={level}")
        sums: dict[tuple, dict] = {}
        for s, c, shard, take, p, n, rows in open_.groupBy("source", "copy", "shard", "take", "part").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect():
            sums.setdefault((s, c, shard, take), {})[p] = (n, rows)
        whole, more, last = [], [], []
        for (s, c, shard, take), parts in sorted(sums.items()):
            left, order = take, sorted(parts)
            for p in rng.permutation(order):
                n, rows = parts[int(p)]
                if n <= left:
                    whole.append((s, c, int(p), None))
                    left -= n
                else:
                    (more if rows > CUT_ROWS else last).append((s, c, int(p), left))
                    break
        named = "source string, copy int, part int, left_over bigint"
        taken = lambda rows: open_.join(spark.createDataFrame(rows, named), ["source", "copy", "part"])
        out.append(taken(whole).drop("left_over"))
        order = Window.partitionBy("source", "block", "copy").orderBy(F.xxhash64(F.lit(seed), "copy", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        ends = taken(last).withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("before + n_tokens / 2 <= left_over")
        out.append(ends.drop("before", "left_over"))
        if not more:
            return reduce(DataFrame.unionByName, [x.drop("part") for x in out])
        open_ = taken(more).drop("part", "take").withColumnRenamed("left_over", "take")
        level += 1


def mix(
    spark: SparkSession, documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int | None = None, seed: int = 7, blocks: int = BLOCKS, folder: str = TOKENIZERS
) -> tuple[DataFrame, list[Quota]]:
    """The mixture (doc_id, source, copy, shard, n_tokens, shuffle_key) and the quotas.

    Sources are trimmed and in lower case; documents whose source is null, empty or without target
    are left out, as are documents without tokens. A document stands at most max_repeats times in the
    mixture. The number of shards follows the size unless it is given. Empty tables give an empty mixture.
    """
    name = F.lower(F.trim("source"))
    wanted = [(r[0], r[1], r[2]) for r in targets.select(name, "target_share", "max_repeats").where("source is not null").distinct().orderBy("lower(trim(source))").collect()]
    listed = targets.select(name.alias("t_source")).distinct()
    sized = token_counts(documents.withColumn("source", name), ["doc_id", "source"], folder)
    sized = sized.where("n_tokens > 0").join(listed, F.col("source") == F.col("t_source"), "left_semi")
    sized = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"))
    place = scratch_path(spark, "sized")
    sized = materialize(sized, f"{place}/all")
    sums: dict[str, dict[int, int]] = {}
    for s, b, n in sized.groupBy("source", "block").agg(F.sum("n_tokens")).collect():
        sums.setdefault(s, {})[b] = n
    sums = {s: dict(sorted(x.items())) for s, x in sums.items()}
    plan = quotas(wanted, {s: sum(x.values()) for s, x in sums.items()}, total)
    count = shards or max(LEAST_SHARDS, -(-sum(q.quota for q in plan) // SHARD_TOKENS))
    drawn = places(plan, sums, count, seed)
    whole = sized.join(spark.createDataFrame([p for p in drawn if p[4] is None], PLACES), ["source", "block"])
    cut = _finish(sized, [p for p in drawn if p[4] is not None], blocks, seed, place)
    key = F.xxhash64(F.lit(seed), "shard", "copy", "doc_id").alias("shuffle_key")
    return whole.drop("take").unionByName(cut.drop("take")).select("doc_id", "source", "copy", "shard", "n_tokens", key), plan


def reached(spark: SparkSession, mixture: DataFrame, plan: list[Quota]) -> DataFrame:
    """Per source of the targets: share wanted and reached in the whole mixture, tokens and repetition."""
    schema = "source string, target_share double, max_repeats int, tokens_available bigint, quota bigint"
    wanted = spark.createDataFrame([tuple(q) for q in plan], schema)
    got = mixture.groupBy(F.col("source").alias("g_source")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("copy").alias("top"))
    every = Window.partitionBy(F.lit(1))  # one row per source of the targets
    return (
        wanted.join(got, F.col("source") == F.col("g_source"), "left")
        .withColumn("whole", F.sum("n").over(every))
        .select(
            "source",
            "target_share",
            "max_repeats",
            "tokens_available",
            F.coalesce("n", F.lit(0)).alias("tokens"),
            F.coalesce("rows", F.lit(0)).alias("n_rows"),
            F.coalesce(F.col("top") + 1, F.lit(0)).cast("int").alias("most_copies"),
            F.round(F.coalesce("n", F.lit(0)) / F.col("whole"), 6).alias("share_reached"),
        )
    )


def write_shards(mixture: DataFrame, path: str) -> DataFrame:
    """One folder per shard, each shuffled by its key; gives the written table. A shard is about SHARD_TOKENS, so one task sorts it."""
    schema = mixture.schema
    mixture.repartition("shard").sortWithinPartitions("shard", "shuffle_key").write.mode("overwrite").partitionBy("shard").parquet(path)
    return mixture.sparkSession.read.schema(schema).parquet(path)
