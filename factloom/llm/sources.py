"""Source files that do not parse, with the token that fails, and their rates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import file_extension
from factloom.session import spread_out

#: Verdicts kept per worker, so that copied files are parsed once; a bound on memory, not on files.
KEPT_VERDICTS = 50_000

VERDICTS = "file_id bigint, project_id string, path string, language string, valid boolean, failure string, offset bigint, line bigint, token string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from factloom.llm.parsing import verdict

    kept: dict[bytes, tuple] = {}
    for batch in batches:
        found = []
        for text, language in zip(batch["source"], batch["language"]):
            key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, person=language.encode()[:16]).digest()
            if key not in kept:
                if len(kept) >= KEPT_VERDICTS:
                    kept.clear()
                v = verdict(text, language)
                kept[key] = (v.valid, v.failure, v.offset, text.count("\n", 0, v.offset) + 1 if not v.valid else -1, v.token)
            found.append(kept[key])
        out = batch[["file_id", "project_id", "path", "language"]].reset_index(drop=True)
        yield pd.concat([out, pd.DataFrame(found, columns=["valid", "failure", "offset", "line", "token"])], axis=1)


def verdicts(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` whose path's extension names a language and whose source is not null.

    ``files`` has file_id, project_id, path and source; other columns are ignored. Whole texts are
    parsed. An empty source is valid except as JSON. failure is ``truncated`` where the text ends
    while more must follow, ``token`` where the derivative by a token is empty; offset,
    line and token then say where. Rows keep no order; repeated rows come out repeated.
    """
    from factloom.llm.parsing import LANGUAGES

    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    cases = files.select("file_id", "project_id", "path", known[file_extension(F.col("path"))].alias("language"), "source").where(
        "language is not null and source is not null"
    )
    return spread_out(cases).mapInPandas(_judge, VERDICTS)


def invalid_rates(judged: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per project_id and language; a file_id counts once."""
    once = judged.groupBy("project_id", "language", "file_id").agg(F.max(~F.col("valid")).alias("bad"), F.max(F.col("failure") == "truncated").alias("cut"))
    return once.groupBy("project_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("bad").alias("n_invalid"),
        F.count_if("cut").alias("n_truncated"),
        F.round(F.count_if("bad") / F.count(F.lit(1)), 6).alias("invalid_rate"),
    )
