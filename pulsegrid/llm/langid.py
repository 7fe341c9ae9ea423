"""Language identification by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import give_back, is_held_out, keep_only, materialize, others, small

BITS = 14
ORDERS = 4
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower-case letters with one space for each run of anything else; empty if there is no letter."""
    plain = _NOT_LETTERS.sub(" ", (text or "").lower())
    return f" {plain.strip()} " if any(map(str.isalpha, plain)) else ""


def buckets_of(plain: str) -> np.ndarray:
    """Hashed buckets of all character n-grams of 1 to ORDERS characters, with repeats."""
    codes = np.frombuffer(plain.encode("utf-32-le", "replace"), "<u4")
    made, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        made.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(made)


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 0 and 1 for each bucket, divided by their length so that products are kernel values; which rows have letters."""
    rows, known = np.zeros((len(texts), 1 << BITS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        plain = letters_of(text)
        if plain:
            rows[i, buckets_of(plain)] = 1
            known[i] = True
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1)), known


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # buckets x classes: landmarks' rows times their dual weights


def fit_kernel_ridge(rows: np.ndarray, labels: list[str], landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """One-versus-rest kernel ridge regression in the Nyström space of landmarks dealt in turn from each class, one of each at least.

    K(x, y) counts the n-grams in both texts, over the root of both texts' counts. With landmarks L and
    K(L, L) = U diag(s) U', texts map to K(x, L) U s^-1/2, where ridge regression to +1 and -1 is solved. As kernels are
    products of presence rows, the model folds into one matrix: scores = x (L' U s^-1/2 W).
    """
    classes = sorted(set(labels))
    at = {c: [i for i, x in enumerate(labels) if x == c] for c in classes}
    turns = max(map(len, at.values()))
    chosen = [at[c][k] for k in range(turns) for c in classes if k < len(at[c])][: max(landmarks, len(classes))]
    L = rows[chosen].astype(np.float64)
    s, u = np.linalg.eigh(L @ L.T)
    whiten = u[:, s > 1e-8] / np.sqrt(s[s > 1e-8])
    space = (rows @ (L.T @ whiten).astype(np.float32)).astype(np.float64)  # the sample itself stays in single precision
    goal = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    weight = np.sqrt(1.0 / np.array([len(at[x]) for x in labels]))[:, None]  # classes count alike
    A = (space * weight).T @ (space * weight) + ridge * np.eye(space.shape[1]) / len(classes)
    W = np.linalg.solve(A, (space * weight).T @ (goal * weight))
    return Model(classes, (L.T @ whiten @ W).astype(np.float32))


def training_rows(df: DataFrame, key: str, text: str, lang: str, sample: int, per_class: int, seed: int) -> tuple[np.ndarray, list[str]]:
    """Presence rows of labelled rows drawn by a hash of id and text; held-out rows are left out, repeated rows count once.

    The sample of about `sample` rows is dealt evenly to the languages, at most per_class and at least one to each: the first rows of a language in
    the order of their hashes. Every language is learned, so beyond `sample` languages the sample is as large as their number.
    """
    train = df.where(~is_held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("c"))
    hashed = F.xxhash64(F.lit(seed), "k", "t")
    counts = materialize(train.groupBy("c").agg(F.approx_count_distinct(hashed, 0.05).alias("count")), "languages")  # repeated rows once; what the draw spares covers the error
    n_classes = counts.count()
    if not n_classes:
        return np.zeros((0, 1 << BITS), np.float32), []
    scale, each = 1 << 30, max(1, min(per_class, sample // n_classes))
    # a hash test first, with so much to spare that a language of many rows has `each` left in all but one of e^20 draws, and one of few rows all its rows
    spare = each + 7 * each**0.5 + 24
    limits = small(counts.select("c", F.least(F.lit(scale), F.ceil(F.lit(float(scale) * spare) / F.col("count"))).alias("limit")))
    drawn = train.withColumn("h", F.pmod(hashed, F.lit(scale))).join(limits, "c").where(F.col("h") < F.col("limit"))
    drawn = drawn.select("k", "t", "c", "h").dropDuplicates(["k", "c", "h"])
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("h", "k"))).where(F.col("at") <= each).select("k", "t", "c")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only()
        for batch in batches:
            for lo in range(0, len(batch), 64):
                rows = batch.iloc[lo : lo + 64]
                flags, known = presence(list(rows["t"]))
                packed = np.packbits(flags > 0, axis=1)
                yield pd.DataFrame({"c": rows["c"][known].tolist(), "bits": [packed[i].tobytes() for i in np.nonzero(known)[0]]})

    got = sorted(drawn.mapInPandas(features, "c string, bits binary").collect())
    if not got:
        return np.zeros((0, 1 << BITS), np.float32), []
    got = [got[i] for i in np.random.default_rng(seed).permutation(len(got))]
    rows = np.empty((len(got), 1 << BITS), np.float32)
    for i, r in enumerate(got):
        rows[i] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8))
        rows[i] /= max(1.0, float(np.sqrt(rows[i].sum())))
    return rows, [r["c"] for r in got]


def identify(df: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000, per_class: int = 500, landmarks: int = 192, seed: int = 10, batch: int = 64) -> DataFrame:
    """Adds lang_pred and score (0 to 1: the softmax of the class scores) to df; the text stays.

    Learns from `labelled` (default: df itself): text and non-null lang of about `sample` rows whose id isn't held out, dealt evenly
    to the languages (training_rows). Every whole text of df is scored in batches by one matrix product each. A null text or one
    without a letter is `und` with score 0, as is every text if nothing can be learned. Columns of df with these
    names are replaced; repeated rows get equal answers; an empty table gives no rows.
    """
    rows, names = training_rows(df if labelled is None else labelled, key, text, lang, sample, per_class, seed)
    model = fit_kernel_ridge(rows, names, landmarks) if names else None
    del rows
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^14 numbers a language

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only()
        known_model = shared.value
        for rows in batches:
            pred, sure = np.full(len(rows), "und", object), np.zeros(len(rows))
            for lo in range(0, len(rows), batch):
                if known_model is None:
                    break
                flags, known = presence(list(rows[text].iloc[lo : lo + batch]))
                points = 4.0 * (flags @ known_model.weights).astype(np.float64)
                chances = np.exp(points - points.max(axis=1, keepdims=True))
                chances /= chances.sum(axis=1, keepdims=True)
                best = chances.argmax(axis=1)
                at = lo + np.nonzero(known)[0]
                pred[at] = [known_model.classes[b] for b in best[known]]
                sure[at] = chances[np.arange(len(best)), best][known]
            yield rows.assign(lang_pred=pred, score=sure)
        give_back()

    kept = df.select(*others(df, "lang_pred", "score"))
    schema = kept.schema
    from pyspark.sql.types import StructType

    return kept.mapInPandas(score, StructType(list(schema.fields)).add("lang_pred", "string").add("score", "double"))
