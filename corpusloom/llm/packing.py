"""Documents into containers of a fixed number of tokens, by sum-of-squares packing.

A document goes where the squared counts of open containers per residual gap become smallest, which keeps gaps of all
sizes at hand. Tasks pack a bounded number of documents each; containers that a task leaves rather empty are opened again
and their contents packed by the next, smaller round, so that the waste does not grow with the number of tasks.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable

#: Tokens of a container, documents a task packs, and the share of a container that is full enough to stay closed.
CAPACITY, TASK_ITEMS, FULL = 2048, 200_000, 0.995
#: Rounds over what earlier rounds left in rather empty containers.
ROUNDS = 4
#: Characters after which a text is handed to the tokenizer in parts, cut at the next space between two letters: there the
#: pattern of the vocabulary ends a token whatever comes before or after, so that the parts have the tokens of the whole.
PART, _CUT = 200_000, re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
#: The vocabulary whose tokens are counted, in the folder of public tokenizers (a parameter where it is elsewhere).
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed collection of public tokenizers has the file ``name``."""
    found = importlib.util.find_spec("public_tokenizers")
    if found is None or not found.submodule_search_locations:
        raise FileNotFoundError("give the path of a tokenizer vocabulary")
    return f"{list(found.submodule_search_locations)[0]}/{name}"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of at least ``size`` characters whose tokens are those of the whole; one part where no cut is safe."""
    start = 0
    while cut := _CUT.search(text, start + size):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def token_counts(df: DataFrame, text: str, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text``: 0 for NULL and empty texts. Special tokens' strings are ordinary text."""
    path = path or vocabulary_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: sum(len(encode(p)) for p in parts(t)) if t else 0).astype("int64")

    return df.withColumn(name, F.coalesce(count(F.col(text)), F.lit(0)))


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size, in the order given; sizes lie between 1 and ``capacity``.

    counts[g] is the number of open containers with gap g. Moving a container from gap g to g - s changes the sum of
    squares by 2 (counts[g - s] - counts[g]) + 2, opening one by 2 counts[capacity - s] + 1; full and empty containers do
    not count. Of equal changes the smallest gap that fits is taken.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = np.empty(len(sizes), dtype=np.int64), 0
    for i, s in enumerate(sizes):
        s = int(s)
        here = counts[s:capacity]
        change = np.where(here > 0, 2 * (counts[: capacity - s] - here) + 2, np.iinfo(np.int64).max)
        if len(here) and here[0] > 0:
            change[0] = 1 - 2 * int(here[0])
        g = int(change.argmin()) + s if len(here) else capacity
        fresh = 2 * int(counts[capacity - s]) + 1 if s < capacity else 0
        if len(here) and here[g - s] > 0 and change[g - s] <= fresh:
            b = open_at[g].pop()
            counts[g] -= 1
        else:
            g, b = capacity, n
            n += 1
        if g - s:
            counts[g - s] += 1
            open_at[g - s].append(b)
        out[i] = b
    return out


def _round(items: DataFrame, number: int, tasks: int, capacity: int, full: float) -> DataFrame:
    """Items with the container they got, and whether it is full enough to keep."""
    cols = "doc_id long, piece int, first_token long, n_tokens int, container string, slot int, kept boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"doc_id": [], "piece": [], "first_token": [], "n_tokens": []})])
        if not len(pdf):
            return
        task = TaskContext.get().partitionId()
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        b = pack(pdf["n_tokens"].to_numpy(), capacity)
        load = np.bincount(b, pdf["n_tokens"])
        pdf["container"] = [f"{number}-{task}-{x}" for x in b]
        pdf["slot"] = pdf.groupby(b).cumcount().astype("int32")
        pdf["kept"] = load[b] >= full * capacity
        yield pdf[["doc_id", "piece", "first_token", "n_tokens", "container", "slot", "kept"]]

    plain = items.select("doc_id", "piece", "first_token", "n_tokens")
    # in turn and not by key, since one doc_id may hold many rows; Spark sorts before, so that a task that runs again deals alike
    return plain.repartition(tasks).mapInPandas(run, cols)


def pack_documents(sized: DataFrame, capacity: int = CAPACITY, task_items: int = TASK_ITEMS, full: float = FULL, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container, slot): where each document of ``sized`` (doc_id, n_tokens) goes.

    A document longer than ``capacity`` is cut: full pieces have a container to themselves, the rest is packed like other
    documents. No other is cut. Documents without tokens (NULL and empty texts) have one row without a container. The
    container and slot of every document come out; repeated doc_ids are separate documents with separate places.
    Equal input in equal partitions gives equal containers. Empty input gives no rows.
    """
    docs = durable(sized.select(F.col("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size")), "sized")
    whole = F.floor((F.col("size") - 1) / F.lit(capacity)).cast("int")
    pieces = docs.filter("size > 0").select("doc_id", "size", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    done = [
        docs.filter("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("slot")),
        pieces.filter(F.col("n_tokens") == capacity).select("*", F.format_string("f-%d-%d-%d", "doc_id", "piece", F.monotonically_increasing_id()).alias("container"), F.lit(0).alias("slot")),
    ]
    left = pieces.filter(F.col("n_tokens") < capacity)
    n = left.count()
    for number in range(rounds):
        tasks = max(1, -(-n // task_items))
        last = tasks == 1 or number == rounds - 1
        step = durable(_round(left, number, tasks, capacity, 0.0 if last else full), f"packed{number}")
        done.append(step.filter("kept").drop("kept"))
        left = step.filter("NOT kept")
        n = left.count()
        if not n:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
