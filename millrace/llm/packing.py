"""Filling fixed-capacity containers with documents, by harmonic classes.

A document of size s belongs to class j = floor(capacity / s): j of them fit one container whatever
their exact sizes, so a container of class j takes j documents of the class and is at least
j / (j + 1) full. Each worker packs the documents of its own partition, with no shuffle: it keeps
their ids and sizes only, never the texts. What room a container has left is then filled with the
largest documents of later classes that fit, so a worker leaves little unused. A document is cut only if it is larger than a container:
into full containers and a rest that is packed like any other document.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.parallel import spread
from millrace.sources import read_table

#: Path of the tokenizer's ranks, unless one is given: it must be there on every executor, or be shipped by ``addFile``.
TOKENIZER = os.environ.get("MILLRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how the tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """Byte-level tokenizer of the ranks file at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Number of tokens of each text; null counts 0."""
    encode = tokenizer(path).encode_ordinary
    return [len(encode(t)) if isinstance(t, str) else 0 for t in texts]


class _Stock:
    """Items by integer size; hands out the largest one that fits."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        self.items = order.tolist()
        edges = np.searchsorted(sizes[order], np.arange(capacity + 2))
        self.start = edges[:-1].tolist()
        self.end = edges[1:].tolist()
        #: below[s]: a size at or below s that may still have items; -1 for none.
        self.below = list(range(capacity + 1))

    def largest(self, room: int) -> int:
        """The largest size with items that is at most ``room``, or -1."""
        below, path, s = self.below, [], room
        while s >= 0:
            if below[s] == s:
                if self.start[s] < self.end[s]:
                    break
                below[s] = s - 1
            path.append(s)
            s = below[s]
        for p in path:
            below[p] = s
        return s

    def take(self, size: int) -> int:
        self.end[size] -= 1
        return self.items[self.end[size]]


def harmonic(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are integers from 0 to ``capacity``.

    Containers are numbered from 0. A container of class j takes j items of the class, or what is left of
    them, and is then filled up with the largest items of later classes, so that no item that is left
    would fit. Items of size 0 go where there is room, and if there are no others, together.
    """
    out = np.full(len(sizes), -1)
    stock = _Stock(sizes, capacity)
    bins = 0
    while (size := stock.largest(capacity)) > 0:
        j = capacity // size
        least = capacity // (j + 1) + 1  # sizes of class j: least .. capacity // j
        members, room = [], capacity
        while len(members) < j and (s := stock.largest(capacity // j)) >= least:
            members.append(stock.take(s))
            room -= s
        while (s := stock.largest(room)) >= 0:  # fill up from the other classes
            members.append(stock.take(s))
            room -= s
        out[members] = bins
        bins += 1
    out[out < 0] = bins  # of size 0, where no other item is
    return out


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece number, first token, tokens, container) of every piece."""
    full = np.where(sizes > capacity, sizes // capacity, 0)
    left = sizes - full * capacity
    # Items whose size is a multiple of the capacity have no rest.
    has_rest = (left > 0) | (full == 0)
    packed = np.flatnonzero(has_rest)
    where = harmonic(left[packed], capacity)
    first = int(where.max()) + 1 if len(where) else 0
    item = np.repeat(np.arange(len(sizes)), full)
    number = np.arange(len(item)) - np.repeat(np.cumsum(full) - full, full)
    items = np.concatenate((item, packed))
    numbers = np.concatenate((number, full[packed]))
    return items, numbers, numbers * capacity, np.concatenate((np.full(len(item), capacity), left[packed])), np.concatenate((first + np.arange(len(item)), where))


def packed(df: DataFrame, id_column: str, text: str, capacities: list[tuple[int, int]], tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(capacity_id, container_id, id, piece_no, first_token, n_tokens): every document in containers of every capacity.

    ``capacities`` are (id, tokens), a few; tokens below 1 raise ValueError. Null and empty texts
    have size 0 and are assigned too; null ids and repeated rows are packed like others. A
    container's id is unique within its capacity. An empty table gives no rows.
    """
    if bad := [c for c in capacities if c[1] is None or c[1] < 1]:
        raise ValueError(f"capacities below 1: {bad}")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sizes = [], []
        for pdf in batches:
            ids.append(pdf["id"])
            sizes.append(np.array(token_counts(pdf["text"].tolist(), tokenizer_path), dtype=np.int64))
        if not ids:
            return
        all_ids, all_sizes = pd.concat(ids, ignore_index=True), np.concatenate(sizes)
        base = TaskContext.get().partitionId() << 36
        for capacity_id, capacity in capacities:
            items, numbers, starts, lengths, where = pack(all_sizes, capacity)
            for a in range(0, len(items), 50_000):
                cut = slice(a, a + 50_000)
                yield pd.DataFrame({"capacity_id": capacity_id, "container_id": base + where[cut], "id": all_ids.iloc[items[cut]].to_numpy(), "piece_no": numbers[cut], "first_token": starts[cut], "n_tokens": lengths[cut]})

    narrow = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return spread(narrow).mapInPandas(work, "capacity_id int, container_id long, id long, piece_no int, first_token long, n_tokens long")


def capacities_of(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The container sizes: a fixed table of a few rows."""
    return [(r["capacity_id"], r["tokens"]) for r in read_table(spark, sf_dir, "pack_capacity").collect()]


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", capacities_of(spark, sf_dir))
    return found.withColumnRenamed("id", "doc_id")


def p8_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share for each capacity."""
    size = read_table(spark, sf_dir, "pack_capacity")
    per_bin = p8_pack(spark, sf_dir).groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("docs"))
    total = per_bin.groupBy("capacity_id").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return total.join(size, "capacity_id").select("capacity_id", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("tokens"))).alias("unused"))


QUERIES = {"p8_pack": p8_pack, "p8_unused": p8_unused}
ORACLE: dict[str, str] = {}
