"""A quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CACHES, WORD_RE, is_held_out, keep_only, others

BITS = 18
_RUNS = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[a-zß-öø-ÿ]+|[0-9]+|[^\W\d_]+")


def shape_of(word: str) -> str:
    """A word with its runs of capitals, small letters, digits and other letters each cut to one sign: Thre*** is Aa***."""
    return _RUNS.sub(lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "0" if m[0].isdigit() else "x", word)


class _Words(dict):
    """Hashes of a word and its shape, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape_of(word).encode("utf-8", "replace"))
        if len(self) < 150_000:
            self[word] = value
        return value


_WORDS = _Words()
CACHES.append(_WORDS)


def indicators(text: str | None) -> np.ndarray:
    """Hashed n-grams that a text has, each once: words and word pairs, shapes in runs of 1 to 3, and runs of 1 to 3 signs
    that tell whether a word equals the one before it."""
    words = WORD_RE.findall(text or "")
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(words), np.uint64)
    same[1:] = 1 + (word[1:] == word[:-1])
    made = []
    for salt, signs, most in ((1, word, 2), (2, shape, 3), (3, same, 3)):
        h = np.full(len(signs), salt, np.uint64)
        for n in range(1, most + 1):
            if len(signs) < n:
                break
            h = h[: len(signs) - n + 1] * np.uint64(0x100000001B3) + signs[n - 1 :] + np.uint64(1)
            made.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    made.append(np.array([0], np.uint64))  # the bias, and all that an empty text has
    return np.unique(np.concatenate(made)).astype(np.uint32)


@dataclass
class Model:
    weights: np.ndarray
    ratios: np.ndarray
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        x = self.ratios[found]
        margin = float((x * self.weights[found]).sum() / max(np.sqrt((x * x).sum()), 1e-9))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))


def fit_nbsvm(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, smooth: float = 1.0, rounds: int = 12, seed: int = 3) -> Model:
    """Indicators scaled by r = log(p / |p|) - log(q / |q|), p and q the smoothed counts of a feature in good and bad texts; then
    a linear hinge-loss model in its dual: one weight a in [0, cost] for each row, set to its best value in turn.

    The margin becomes a chance by a logistic fit to the rows' own margins. Rows of one class only give a constant.
    """
    size = 1 << BITS
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(size), np.ones(size), 1.0, 0.0 if not len(rows) else 6.0 if labels.max() else -6.0)
    p, q = np.full(size, smooth), np.full(size, smooth)
    for found, y in zip(rows, labels):
        (p if y else q)[found] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[0] = 1.0
    y = np.where(labels > 0, 1.0, -1.0)
    values = [ratio[f] / max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for f in rows]
    limits = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))  # classes count alike
    a, w, rng = np.zeros(len(rows)), np.zeros(size), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i]) - 1  # rows have length 1
            new = min(max(a[i] - slope, 0.0), limits[i])
            if new != a[i]:
                w[rows[i]] += (new - a[i]) * y[i] * values[i]
                a[i] = new
    margins = np.array([w[f] @ v for f, v in zip(rows, values)])
    slope, shift = 1.0, 0.0
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):  # Newton steps of the logistic fit
        chance = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -60, 60)))
        v, d = chance * (1 - chance) + 1e-9, chance - goal
        H = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(H, [(d * margins).sum(), d.sum()])
        slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
    return Model(w.astype(np.float64), ratio, slope, shift)


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 3000, seed: int = 3) -> Model:
    """Fits on about per_class labelled rows of each class, drawn by a hash of their id; held-out ids are left out.

    Labels that are null or of null ids don't count; of an id's several labels the lowest counts, of its several texts the first in code point order (null is empty).
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    if not counts:
        return fit_nbsvm([], np.zeros(0))
    scale = 1 << 30
    rate = F.when(F.col("y") == 1, F.lit(scale * per_class // counts.get(1, 1))).otherwise(F.lit(scale * per_class // counts.get(0, 1)))
    drawn = known.where("y in (0, 1)").where(F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(scale)) < rate)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"k": rows["k"], "y": rows["y"], "found": [indicators(t).astype("<u4").tobytes() for t in rows["t"]]})

    texts = df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(drawn), "k")  # about 2 * per_class rows
    rows = texts.groupBy("k", "y").agg(F.min("t").alias("t"))
    got = sorted(rows.mapInPandas(features, "k long, y int, found binary").collect())
    return fit_nbsvm([np.frombuffer(r["found"], "<u4") for r in got], np.array([r["y"] for r in got]), seed=seed)


def score_quality(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted to df without its text; whole texts, null as empty. Columns with these names are replaced."""
    from pyspark.sql.types import StructType

    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 x 2^18 numbers
    kept = [c for c in others(df, "score", "predicted") if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only(_WORDS)
        for rows in batches:
            points = np.array([shared.value.score(indicators(t)) for t in rows[text]])
            yield rows[kept].assign(score=points, predicted=(points >= threshold).astype("int32"))

    schema = StructType([df.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")
    return df.select(*kept, F.col(text)).mapInPandas(run, schema)
