"""Passages of evaluation texts inside a training corpus, by size-partitioned MinHash containment.

A MinHash of a whole long document says nothing about twelve words of it, so items and documents are cut into passages
of the sizes SIZES before they are hashed, and only passages of one size are compared with each other: of two sets of
about the same size, containment is similarity. An item takes part in every size it reaches. A passage's MinHash is the
least of the hashes of its five-word shingles; the smallest size has one hash function, since equal passages always have
equal MinHashes, so that no WORDS words in sequence are missed; the larger sizes have HASHES functions, each a band of
its own, so that passages that are contained but for some changed words meet as well. Neighbouring passages mostly share
their MinHashes, so that a document is indexed by a fraction of its words. What meets is a candidate and is verified
exactly: by the words in sequence, or by the share of the item's shingles that the document contains.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, durable

#: Consecutive words that make a leak, words of a shingle, words of the passages that are compared.
WORDS, SHINGLE = 12, 5
SIZES = (WORDS, 24, 48, 96)
#: Hash functions of the passages above the smallest, and the containment from which an item counts as contained.
HASHES, CONTAINED = 3, 0.8

#: A tag is any of up to 300 characters, or one of any length that is made of attributes: values may be as long as they like,
#: but prose after a stray "<b" is no tag.
_TAG = re.compile(
    r"<!--.*?-->|</?[a-zA-Z][^<>]{0,300}>|</?[a-zA-Z][^<>=\"']{0,300}+(?:=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=]*+)[^<>=\"']{0,300}+)++>|<[!?][^<>]{0,300}>|<!(?:DOCTYPE|ENTITY|ELEMENT|ATTLIST)\b[^<>]*+>|<\?[a-zA-Z][^<>?]*+\?>",
    re.S | re.I,
)
#: A link's target: in angle brackets (which are gone as a tag), without spaces, or with spaces if it begins like an address;
#: parentheses in it are balanced, and a title may follow.
_LINK = re.compile(
    r"(!?)\[([^\[\]]*)\]\(\s*+(?:(?:<[^<>\n]*>)?|(?:[^()\s]|\((?:[^()\s]|\([^()\s]*\))*\))+|(?:[a-z][a-z+.-]*:|www\.|[./#?])(?:[^()\n\"']|\([^()\n]*\))*?)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)",
    re.I,
)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_INSIDE = re.compile("[\\u00ad\\u200b-\\u200d\\u2060\\ufeff]")
_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of ``text``, without markup, in one Unicode composition and letter case."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(r" \2 ", text)
    if "&" in text:
        text = _TAG.sub(" ", _ENTITY.sub(lambda m: html.unescape(m[0]), text))
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INSIDE.sub("", text))
    return _RUN.findall(text.casefold())


def _hashes(tokens: list[str]) -> np.ndarray:
    held: dict[str, int] = {}
    return np.array([held.get(t) or held.setdefault(t, xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in tokens], dtype=np.uint64)


def _rolled(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of every ``n`` consecutive entries of ``h``."""
    size = len(h) - n + 1
    out = np.full(size, seed, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive entries, by doubling."""
    have = 1
    while have * 2 <= width:
        a, have = np.minimum(a[:-have], a[have:]), have * 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def signatures(tokens: list[str], sizes: tuple[int, ...] = SIZES, shingle: int = SHINGLE, hashes: int = HASHES) -> dict[int, np.ndarray]:
    """For each of ``sizes`` the different MinHashes of all passages of so many words, each marked by size and function."""
    out: dict[int, np.ndarray] = {}
    if not sizes or len(tokens) < min(sizes):
        return out
    parts = _rolled(_hashes(tokens), shingle, 11)
    for n in sizes:
        if len(tokens) >= n:
            found = [_mixed(np.unique(_sliding_least(_mixed(parts, j + 1), n - shingle + 1)), n * 64 + j) for j in range(hashes if n > min(SIZES) else 1)]
            out[n] = np.concatenate(found).view(np.int64)
    return out


def _indexed(df: DataFrame, key: str, text: str, sizes: tuple[int, ...], shingle: int, hashes: int) -> DataFrame:
    """(``key``, size, minhash): every different MinHash of a text once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, lengths, mins = [], [], []
            for k, t in pdf.itertuples(index=False):
                for n, m in signatures(words(t), sizes, shingle, hashes).items():
                    keys.append(np.full(len(m), k, dtype=np.int64))
                    lengths.append(np.full(len(m), n, dtype=np.int32))
                    mins.append(m)
            if keys:
                yield pd.DataFrame({key: np.concatenate(keys), "size": np.concatenate(lengths), "minhash": np.concatenate(mins)})

    return df.select(key, text).mapInPandas(run, f"{key} long, size int, minhash long")


def candidates(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, sizes: tuple[int, ...] = SIZES, shingle: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """(``doc_key``, ``item_key``): the pairs with a passage of one size and MinHash in common, written.

    Documents are indexed only in the sizes that some item reaches.
    """
    wanted = durable(_indexed(items.filter(F.col(item_key).isNotNull()), item_key, text, sizes, shingle, hashes), "items")
    used = tuple(sorted(r["size"] for r in wanted.select("size").distinct().collect()))
    held = docs.filter(F.col(doc_key).isNotNull() & F.col(text).isNotNull())
    index = _indexed(held, doc_key, text, used, shingle, hashes).drop("size")
    return durable(index.join(broadcast_if_small(wanted.drop("size"), wanted.count()), "minhash").select(doc_key, item_key).distinct(), "candidates")


def _exact(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(``key``, passage): every different sequence of ``n`` words as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, out = [], []
            for k, t in pdf.itertuples(index=False):
                w = words(t)
                own = dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
                keys += [k] * len(own)
                out += own
            yield pd.DataFrame({key: keys, "passage": out}).astype({key: "int64"})

    return df.select(key, text).mapInPandas(run, f"{key} long, passage string")


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """(``doc_key``, ``item_key``): pairs where the document holds at least ``n`` consecutive words of the item.

    Words are runs of letters and digits; case, punctuation, markup, white space and Unicode composition do not matter.
    NULL texts and texts under ``n`` words are in no pair. Documents are read whole. A pair comes out once, however often
    the passage occurs; repeated documents are pairs of their own by their keys. An empty side gives no pairs. Keys are
    longs; other columns are not read.
    """
    pairs = candidates(docs, items, doc_key, item_key, text, (n, *[x for x in SIZES if x > n]), shingle)
    few, passages = _to_verify(docs, items, pairs, doc_key, item_key, text, n)
    return few.join(broadcast_if_small(passages, passages.count()), "passage").select(doc_key, item_key).distinct()


def _to_verify(docs: DataFrame, items: DataFrame, pairs: DataFrame, doc_key: str, item_key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Every different sequence of ``n`` words of the documents and of the items that are in ``pairs``."""
    some = lambda df, key: df.join(broadcast_if_small(keys := durable(pairs.select(key).distinct(), key), keys.count()), key, "left_semi")
    held = some(docs.filter(F.col(text).isNotNull()), doc_key)
    return _exact(held, doc_key, text, n), durable(_exact(some(items, item_key), item_key, text, n), "passages")


def contained_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: float = CONTAINED, shingle: int = SHINGLE) -> DataFrame:
    """(``doc_key``, ``item_key``, containment): pairs where the document contains ``least`` of the item's shingles.

    So an item is found that was changed here and there, though no WORDS words of it are left in sequence. Shingles of
    ``shingle`` words count once; words, NULL and empty texts, repeated rows and other columns are as in leaked_items.
    Items under WORDS words are in no pair. Pairs are found with high probability (see the README for the measured
    recall), and their containment is exact.
    """
    pairs = candidates(docs, items, doc_key, item_key, text, shingle=shingle)
    few, own = _to_verify(docs, items, pairs, doc_key, item_key, text, shingle)
    own = own.dropDuplicates([item_key, "passage"])
    met = few.join(broadcast_if_small(own, own.count()), "passage").select(doc_key, item_key, "passage").distinct().groupBy(doc_key, item_key).agg(F.count("*").alias("_n"))
    totals = own.groupBy(item_key).agg(F.count("*").alias("_all"))
    found = met.join(broadcast_if_small(totals, totals.count()), item_key).filter(F.col("_n") >= F.lit(least) * F.col("_all"))
    return found.join(pairs, [doc_key, item_key], "left_semi").select(doc_key, item_key, (F.col("_n") / F.col("_all")).alias("containment"))
