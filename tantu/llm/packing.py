"""Problem 8: filling containers of fixed capacity, by sum of squares."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Where the public vocabularies lie, and the one that sizes texts.
TOKENIZER_DIR = os.environ.get("TANTU_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: The pattern by which the vocabulary's tokenizer cuts words: a fixed value.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(path: str) -> Callable[[str], int]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("sizes", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


class SumOfSquares:
    """Online packing of whole sizes into windows of one capacity.

    levels[h] counts the open windows filled up to h. An item goes to the level (0: a new window) that
    keeps the sum of squared counts smallest; of equal levels to the fullest. A full window is closed.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]

    def place(self, size: int) -> tuple[int, int]:
        """The window the item goes to and the level at which it starts there."""
        c, n = self.capacity, self.levels
        if not 0 < size <= c:
            raise ValueError("an item must be of 1 to capacity tokens")
        # moving a window from h to h + size changes the sum by 2 (n[h + size] - n[h]) + 2; opening one, by 2 n[size] + 1;
        # filling one up, by 1 - 2 n[h]
        change = 2 * (n[size:] - n[: c - size + 1]) + 2
        change[c - size] = 1 - 2 * n[c - size]
        change[n[: c - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1 if size < c else 0
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h == 0:
            window, fill = self.made, 0
            self.made += 1
        else:
            window, fill = self.open[h].pop()
            n[h] -= 1
        if (now := fill + size) < c:
            self.open[now].append((window, now))
            n[now] += 1
        return window, fill


def pack_texts(docs: DataFrame, capacity: int, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(container, at, key, piece_no, start, n_tokens): every text in a container of ``capacity`` tokens of a public tokenizer.

    at is the fill level at which the item begins, start its first token in its text. Only a text larger
    than the capacity is divided: into full containers and a rest, which is packed like any other item. A null
    or empty text takes no room and is in no container; repeated rows are items of their own. Items are
    packed where they are read, without a shuffle; the windows left open at the end of a task are the only
    loss of it. Containers are named task-number, with the task's partition.
    """
    path = tokenizer or f"{TOKENIZER_DIR}/{TOKENIZER}"
    rows = docs.select(F.col(key), F.col(text).alias("__text"), F.spark_partition_id().alias("__part"))
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size_of, packer = token_counter(path), SumOfSquares(capacity)
        for batch in batches:
            out = []
            for k, t, part in zip(batch[key], batch["__text"], batch["__part"], strict=True):
                n = size_of(t) if t else 0
                for no, start in enumerate(range(0, n, capacity)):
                    window, fill = packer.place(min(capacity, n - start))
                    out.append((f"{part}-{window}", fill, k, no, start, min(capacity, n - start)))
            yield pd.DataFrame(out, columns=["container", "at", key, "piece_no", "start", "n_tokens"])

    return rows.mapInPandas(pack, f"container string, at int, `{key}` {kind}, piece_no int, start int, n_tokens int")


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(filled, n_containers, n_tokens, n_items): containers by fill, in tenths of the capacity rounded up."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return each.groupBy(F.ceil(F.col("n") * 10 / capacity).cast("int").alias("filled")).agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_tokens"),
        F.sum("items").alias("n_items"),
    )


def packing_account(packed: DataFrame, capacity: int, *, key: str = "doc_id") -> DataFrame:
    """One row: items, texts, containers and tokens packed; containers above the capacity or with gaps or overlaps; texts that would have fitted whole but are divided; fill."""
    after = F.lead("at").over(Window.partitionBy("container").orderBy("at"))
    placed = packed.withColumn("__next", F.coalesce(after, F.col("at") + F.col("n_tokens")))
    each = placed.groupBy("container").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("items"), F.count_if(
            F.col("__next") != F.col("at") + F.col("n_tokens")
        ).alias("gaps"), F.min("at").alias("first")
    )
    whole = each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.count_if(F.col("n") > capacity).alias("n_over"), F.count_if((F.col("gaps") > 0) | (F.col("first") > 0)).alias("n_gaps"),
    )
    # of a divided text every piece but its last fills a container
    texts = packed.groupBy(key).agg(F.count_if((F.col("n_tokens") < capacity) & (F.col("start") % capacity == 0)).alias("rests"), F.max("piece_no").alias("last"))
    texts = texts.agg(F.count("*").alias("n_texts"), F.count_if((F.col("rests") > 1) & (F.col("last") > 0)).alias("n_needless"))
    return whole.crossJoin(F.broadcast(texts)).withColumn("fill", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * capacity))
