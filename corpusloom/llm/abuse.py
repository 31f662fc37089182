"""Abusive, hateful and sexual content, by a linear classifier over character n-grams.

Texts are undisguised first (look-alike letters, signs for letters, masked, spaced and stretched words, invisible
characters), cut into sentences, and each sentence is scored; a text scores as its worst sentence. The features are hashed
n-grams of ORDERS characters, scaled by their naive Bayes log-count ratios; a logistic regression weights them.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import abuse_seed

#: n-gram lengths, buckets (a power of two), smoothing, ridge penalty and steps of the fit.
ORDERS, BITS, ALPHA, RIDGE, STEPS = (2, 3, 4, 5, 6), 20, 1.0, 1e-5, 30
#: Sentences turned into features at a time, which bounds the memory of the fit.
CHUNK = 1000
#: Labelled sentences drawn for training, rows of the corpus looked at for harmless examples (both bounds), seed.
LABELLED, UNLABELLED, SEED = 16_000, 12_000, 20240613
#: Corpus sentences under CALM in the first fit serve as harmless ones in the second; texts from LIMIT on are cases.
#: BESIDE is the share of labelled sentences that are also taught next to one of those, without a stop between them.
CALM, LIMIT, BESIDE = 0.2, 0.4, 0.5

_INVISIBLE = re.compile("[\\u00ad\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufe00-\\ufe0f\\ufeff]")
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_HANDLE = re.compile(r"(?<!\w)@[\w.-]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·,/|])(?:[^\W\d_]| (?=\1))(?:\1(?:[^\W\d_]| (?=\1)))+(?![^\W_])")
_SIGNED = re.compile(r"(?<![\w@$€])(?=[\w@$€]*[^\W\d_])(?=[\w@$€]*[\d@$€])[\w@$€]{3,}")
_AMOUNT = re.compile(r"[$€]?\d+[^\W\d_]{0,3}[$€]?|[^\W\d_]{1,2}\d+|\w*[2689]\w*")
_MARK = re.compile(r"(?<=[^\W\d_])!+(?=[^\W\d_])")
_MASKED = re.compile(r"[^\W\d_]+(?:[*#%]+[^\W\d_]*)+|[*#%]+[^\W\d_]{2,}")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_QUOTED = re.compile(r"(?<!\w)'[^'\n]{2,90}'(?!\w)|\"[^\"\n]{2,90}\"|[„“”»«‚‘][^„“”»«‚‘’\n]{2,90}[“”«»’‘]")
_DIGIT, _QUOTE = re.compile(r"[\d@$€]"), re.compile("['\"„“”»«‚‘’]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_BREAK = re.compile(r"(?<=[.!?…])['\")\]]*\s+|[\r\n ]+")
_SPACE = re.compile(r"\s+")
#: Signs that insult or threaten by themselves, as words.
_EMOJI = {"🐷": " pigsign ", "🐖": " pigsign ", "🐽": " pigsign ", "🐀": " ratsign ", "🪳": " ratsign ", "🖕": " fingersign ", "🤮": " vomitsign ", "💩": " dungsign "}
_TRANSLATED = str.maketrans(abuse_seed.LOOKALIKES | {"’": "'", "‘": "'", "`": "'", "´": "'"} | _EMOJI)


@functools.lru_cache(maxsize=1)
def _vocabulary() -> dict[int, list[str]]:
    """Words of the training patterns by length, the fillers first: what masked words may stand for."""
    words = dict.fromkeys(w.casefold() for fills in abuse_seed.FILL.values() for f in fills for w in _WORD.findall(f))
    for p in (*abuse_seed.ABUSIVE, *abuse_seed.BELEIDIGEND, *abuse_seed.HARMLESS, *abuse_seed.HARMLOS):
        words |= dict.fromkeys(w.casefold() for w in _WORD.findall(re.sub(r"\{\w+\}", " ", p)))
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    return by


@functools.lru_cache(maxsize=50_000)
def _unmasked(word: str) -> str:
    form = re.compile(re.sub(r"[*#%]", ".", re.sub(r"[^\w*#%]", "", word)))
    return next((w for w in _vocabulary().get(len(word), ()) if form.fullmatch(w)), re.sub(r"[#%]", "*", word))


def undisguise(text: str) -> str:
    """``text`` in lower case as it is read: without tricks that hide words from a filter. Quotations of others inside a
    longer text become the word 'quotation'."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(_TRANSLATED)
    if "://" in text or "www." in text.lower():
        text = _LINK.sub(" ", text)
    text = text.casefold()
    if "@" in text:
        text = _HANDLE.sub(" ", text)
    text = _SPACED.sub(lambda m: m[0][::2], text)
    if _DIGIT.search(text):
        text = _SIGNED.sub(lambda m: m[0] if _AMOUNT.fullmatch(m[0]) else "".join(abuse_seed.SIGNS.get(c, c) for c in m[0]), text)
    if "!" in text:
        text = _MARK.sub("i", text)
    if "*" in text or "#" in text or "%" in text:
        text = _MASKED.sub(lambda m: _unmasked(m[0]), text)
    text = _STRETCHED.sub(r"\1", text)
    if _DIGIT.search(text):
        text = _NUMBER.sub("0", text)
    if _QUOTE.search(text) and _QUOTED.search(text) and len(_WORD.findall(_QUOTED.sub(" ", text))) >= 4:
        text = _QUOTED.sub(" quotation ", text)
    return text


def sentences(text: str) -> list[str]:
    """The undisguised sentences of ``text`` that hold a letter, each between single spaces."""
    return [f" {s.strip()} " for s in (_SPACE.sub(" ", x) for x in _BREAK.split(undisguise(text))) if _WORD.search(s)]


def _features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and the number of the line it is in; lines are padded so that none spans two."""
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line = np.cumsum(codes == 10, dtype=np.int32)
    buckets, owners, h = [], [], np.zeros(len(codes), dtype=np.uint32)
    done = 0
    for n in ORDERS:
        while done < n:
            h = h[: len(codes) - done] * np.uint32(0x9E3779B1) + codes[done:]
            done += 1
        inside = line[: len(h)] == line[n - 1 :] if n > 1 else np.ones(len(h), bool)
        inside &= codes[: len(h)] != 10
        x = (h[inside] ^ np.uint32((n * 0x45D9F3B) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        buckets.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
        owners.append(line[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def score_lines(lines: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The chance of each undisguised sentence to be abusive."""
    if not lines:
        return np.empty(0)
    buckets, owners = _features(lines)
    return 1 / (1 + np.exp(-np.clip(np.bincount(owners, weights[buckets], len(lines)) + bias, -60, 60)))


def fit(lines: list[str], labels: np.ndarray, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias: naive Bayes log-count ratios times the weights of a logistic regression on the scaled features.

    ``start`` is a model to begin the search with.

    Every sentence counts all of its n-grams once, and both classes weigh the same. Equal input gives an equal model.
    """
    y, n, size = np.asarray(labels, dtype=float), len(lines), 1 << BITS
    parts, bad, good = [], np.full(size, ALPHA), np.full(size, ALPHA)
    for at in range(0, n, CHUNK):
        buckets, owners = _features(lines[at : at + CHUNK])
        pairs = np.sort(owners.astype(np.int64) << BITS | buckets)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        owners, buckets = pairs >> BITS, (pairs & (size - 1)).astype(np.int32)
        counts = np.bincount(owners, minlength=len(lines[at : at + CHUNK]))
        mine = y[at : at + CHUNK]
        bad += np.bincount(buckets, np.repeat(mine, counts), size)
        good += np.bincount(buckets, np.repeat(1 - mine, counts), size)
        parts.append((slice(at, at + len(counts)), buckets, counts))
    ratio = np.log(bad / bad.sum()) - np.log(good / good.sum())
    used = np.flatnonzero((bad > ALPHA) | (good > ALPHA))
    ratio, m = ratio[used], len(used)
    place = np.zeros(size, dtype=np.int32)
    place[used] = np.arange(m, dtype=np.int32)
    parts = [(rows, place[buckets], counts) for rows, buckets, counts in parts]
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, z, grad = (ratio * w[:m]).astype(np.float32), np.empty(n), np.zeros(m)
        for rows, buckets, counts in parts:
            z[rows] = np.bincount(np.repeat(np.arange(len(counts)), counts), scaled[buckets], len(counts)) + w[m]
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * balance
        for rows, buckets, counts in parts:
            grad += np.bincount(buckets, np.repeat(g[rows], counts), m)
        value = float((balance * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * (w[:m] @ w[:m]))
        return value, np.append(grad * ratio + RIDGE * w[:m], g.sum())

    first = np.zeros(m + 1)
    if start is not None:
        first[:m], first[m] = np.divide(start[0][used], ratio, out=np.zeros(m), where=np.abs(ratio) > 0.05), start[1]
    w = _minimum(loss, first)
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = w[:m] * ratio
    return weights, float(w[m])


def _minimum(loss, w: np.ndarray, memory: int = 8) -> np.ndarray:
    """Where the smooth convex ``loss`` (value and gradient) is least: limited-memory BFGS with halved steps."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        d, shares = grad.copy(), []
        for s, t, r in reversed(past):
            shares.append(a := r * (s @ d))
            d -= a * t
        if past:
            s, t, r = past[-1]
            d *= 1 / (r * (t @ t))
        for (s, t, r), a in zip(past, reversed(shares)):
            d += s * (a - r * (t @ d))
        step, slope = (1.0 if past else 1 / max(1e-12, np.abs(grad).sum())), grad @ d
        while step > 1e-10:
            new, new_grad = loss(w - step * d)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * d, new_grad - grad
        w, grad, gain, value = w + s, new_grad, value - new, new
        if s @ t > 1e-14:
            past = [*past[1 - memory :], (s, t, 1 / (s @ t))]
        if gain < 1e-3 * max(value, 1e-4):
            break
    return w


@functools.lru_cache(maxsize=2)
def _seed_lines(n: int, seed: int) -> tuple[tuple[str, ...], tuple[int, ...]]:
    texts, labels = abuse_seed.labelled(n, seed)
    lines = [" " + _SPACE.sub(" ", undisguise(t)).strip() + " " for t in texts]
    return tuple(lines), tuple(labels)


@functools.lru_cache(maxsize=2)
def seed_model(n: int = LABELLED, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The model of the labelled sentences alone."""
    lines, labels = _seed_lines(n, seed)
    return fit(list(lines), np.array(labels))


def train(sample: Iterable[str], n: int = LABELLED, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The model of the labelled sentences and, as harmless ones, of those in ``sample`` that the first model finds calm.

    ``sample`` is a bounded number of unlabelled texts of the corpus, so that its everyday language is known as harmless.
    """
    lines, labels = _seed_lines(n, seed)
    own = sorted({s for t in sample if t for s in sentences(t)})
    calm = [s for s, p in zip(own, score_lines(own, *seed_model(n, seed))) if p < CALM]
    rng = random.Random(seed)
    pairs = [(f" {a.strip().rstrip('.')} {b.strip()} " if rng.random() < 0.5 else f" {b.strip().rstrip('.')} {a.strip()} ", y) for a, y in zip(lines, labels) if calm and rng.random() < BESIDE for b in [rng.choice(calm)]]
    return fit([*lines, *calm, *[x for x, _ in pairs]], np.array([*labels, *[0] * len(calm), *[y for _, y in pairs]]), seed_model(n, seed))


def scores(texts: pd.Series, weights: np.ndarray, bias: float) -> pd.Series:
    """The score of each text: that of its worst sentence, 0 without one, NaN for none."""
    lines, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            own = sentences(t)
            lines += own
            counts[i] = len(own)
    out = np.where(texts.isna(), np.nan, 0.0)
    if lines:
        full = np.flatnonzero(counts)
        out[full] = np.maximum.reduceat(score_lines(lines, weights, bias), np.concatenate([[0], np.cumsum(counts[full])[:-1]]))
    return pd.Series(out)


def corpus_sample(tables: list[tuple[DataFrame, str, list[str]]], most: int = UNLABELLED) -> list[str]:
    """At most ``most`` texts of (table, text column, keys), the same ones for the same rows: those with the least hashes.

    Rows above a hash that nearly twice as many rows lie under are left out by each task, so that the driver gets a
    bounded number of texts from however many tasks.
    """
    rows = [df.select(F.col(c).alias("text"), F.xxhash64(*keys).alias("h")) for df, c, keys in tables]
    whole = functools.reduce(DataFrame.unionByName, rows)
    share = min(1.0, (1.8 * most + 1000) / max(1, whole.count()))
    low = whole.filter((F.length("text") > 0) & (F.col("h") <= F.lit(min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))))
    return [r["text"] for r in low.orderBy("h", "text").limit(most).collect()]


def abuse_score(df: DataFrame, text: Column, model: tuple[np.ndarray, float], name: str = "abuse_score") -> DataFrame:
    """``df`` with ``name``, the chance that a text is abusive, hateful or sexually explicit.

    NULL texts get NULL, empty and blank ones 0. Every sentence of a text counts, however long it is. Repeated rows get
    equal scores; a column called ``name`` is replaced. The weights (4 MB, whatever the data) go to every executor once.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = held.value
        for texts in batches:
            yield scores(texts, weights, bias)

    return df.withColumn(name, F.when(text.isNotNull(), score(text)))
