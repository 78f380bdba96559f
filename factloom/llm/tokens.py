"""Token ids of whole texts by a public byte-level BPE.

Encodings of neighbouring pieces are joined as a monoid: only a window around the
joint is encoded anew. The window grows on both sides until it ends at a place which is
a border between words whatever stands around it; tokens outside can't change then, as merges never
cross such a border. Texts longer than a leaf are encoded by halves, recursively.

Why a border is certain: the vocabulary's pattern cuts a text into words of these forms only - an
apostrophe with a few letters; an optional space and letters; an optional space and
digits; an optional space and other signs; white space. None holds a character and then
white space, letters next to digits, letters or digits before other signs, or other signs before
digits; and other signs before letters only after an apostrophe. So between two
such characters every scan, wherever it began, ends one word and begins the next.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import spread_out

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pattern which the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters up to which a text is encoded in one call; most texts are longer and come out of the tree.
LEAF = 64
#: The same where only the number of tokens is wanted; the result does not depend on it.
COUNT_LEAF = 2048


def _kind(c: str) -> str:
    if c.isspace():
        return "W"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "O"


def certain_border(before: str, after: str) -> bool:
    """Whether a word ends between these two characters in any text."""
    a, b = _kind(before), _kind(after)
    if a == "W":
        return False
    if b == "W":
        return not (before.isspace() or "\x1c" <= after <= "\x1f")
    if "\x1c" <= before <= "\x1f" or unicodedata.category(before) == "Cn" or unicodedata.category(after) == "Cn":
        return False  # libraries may class these differently
    return a != b and not (a == "O" and b == "L" and before == "'")


class Encoder:
    def __init__(self, folder: str, name: str = "byte_bpe_50k"):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: len(b) for b, i in ranks.items()}

    def _back(self, ids: list[int], size: int) -> int:
        """Index of the token that begins ``size`` bytes before the end."""
        k = len(ids)
        while size > 0:
            k -= 1
            size -= self._bytes[ids[k]]
        assert size == 0, "a token crosses a certain border"
        return k

    def _forth(self, ids: list[int], size: int) -> int:
        k = 0
        while size > 0:
            size -= self._bytes[ids[k]]
            k += 1
        assert size == 0, "a token crosses a certain border"
        return k

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        p, reach = len(left), 32
        while p > 0 and not (p < len(left) and certain_border(left[p - 1], left[p])):
            lo = max(0, len(left) - reach)
            p = next((i for i in range(min(p, len(left)) - 1, lo, -1) if certain_border(left[i - 1], left[i])), lo if lo == 0 else lo + 1)
            reach *= 2
        q, reach = 0, 32
        while q < len(right) and not (q > 0 and certain_border(right[q - 1], right[q])):
            hi = min(len(right), reach)
            q = next((i for i in range(q + 1, hi) if certain_border(right[i - 1], right[i])), hi)
            reach *= 2
        kept = left_ids[: self._back(left_ids, len(left[p:].encode()))]
        rest = right_ids[self._forth(right_ids, len(right[:q].encode())) :]
        return kept + self._bpe.encode_ordinary(left[p:] + right[:q]) + rest

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self._bpe.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def encode_all(self, texts: list[str | None], leaf: int = LEAF) -> list[list[int]]:
        """Ids of each text; a null and an empty text both give an empty list."""
        short = [t if t is not None and len(t) <= leaf else "" for t in texts]
        out = self._bpe.encode_ordinary_batch(short, num_threads=1)
        return [self.encode(t, leaf) if t is not None and len(t) > leaf else ids for t, ids in zip(texts, out)]

    def decode(self, ids: list[int]) -> str:
        return self._bpe.decode(ids)


def ship(spark: SparkSession, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> None:
    """Send the vocabulary file to all executors, for clusters on which the folder does not exist everywhere."""
    spark.sparkContext.addFile(f"{folder}/{name}.tiktoken")


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a vocabulary in ``folder``, else in what was sent by :func:`ship`."""
    import os

    if not os.path.exists(f"{folder}/{name}.tiktoken"):
        from pyspark import SparkFiles

        folder = SparkFiles.getRootDirectory()
    return Encoder(folder, name)


def _texts(column: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in column]


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids of every row; a null or empty text gives an empty list. No shuffle.

    Repeated rows come out repeated; other columns are ignored. The text is read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": enc.encode_all(_texts(batch["text"]))})

    return spread_out(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The kept columns and n_tokens of every row; only numbers leave the worker."""
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.select(*keep).dtypes) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for batch in batches:
            out = batch[keep].copy()
            out["n_tokens"] = [len(x) for x in enc.encode_all(_texts(batch["text"]), COUNT_LEAF)]
            yield out

    return spread_out(documents.select(*keep, F.col("text"))).mapInPandas(run, schema)
