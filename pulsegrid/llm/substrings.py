"""Substring dedup over sliding spans of sentences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, discard, give_back, in_slices, keep_only, materialize, others, shielded

#: A sentence ends after its mark and white space, or at a line's end; marks of scripts written without spaces need no white space.
_END = re.compile(r"(?<=[.!?…؟۔।॥])[ \t]+|\n+")
_WIDE_END = re.compile(r"(?<=[.!?…؟۔।॥])[ \t]+|(?<=[。！？｡])[ \t]*|\n+")
#: A word; a character of a script written without spaces counts as one.
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_UNIT = re.compile(rf"{_WIDE.pattern}|[^\s{_WIDE.pattern[1:-1]}]+")
#: White space other than blanks and line feeds.
_ODD_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Runs of one or two sentences count too from so many words. A sentence of more than CUT words is
#: taken in pieces, which begin at every word whose hash is a multiple of EVERY; runs with pieces count from TWO words.
#: The cuts follow from the words beside them, so a passage is cut alike in every text.
ONE, TWO, CUT, EVERY = 50, 30, 40, 8
_MASK = (1 << 128) - 1
_HALF = (1 << 63) - 1
#: More than the sentences of any run: each has a word, and a run ends with `run` sentences or least_words words, or TWO words if it holds pieces.
RUN = 64


def sentences(text: str | None) -> list[tuple[int, int, bool]]:
    """Places of sentences and of the pieces of long ones (True); blank ones are left out."""
    out: list[tuple[int, int, bool]] = []
    if not text:
        return out
    wide = not text.isascii() and _WIDE.search(text) is not None
    plain = not wide and not any(map(text.__contains__, _ODD_SPACES))
    at, ends = 0, [m.span() for m in (_WIDE_END if wide else _END).finditer(text)]
    ends.append((len(text), len(text)))
    for stop, after in ends:
        if plain and (stop - at < 2 * CUT or text.count(" ", at, stop) < CUT):  # not more than CUT words
            if stop > at and (not text[at].isspace() or not text[at:stop].isspace()):
                out.append((at, stop, False))
            at = after
            continue
        part = text[at:stop]
        n = len(_UNIT.findall(part)) if wide else len(part.split())
        if n > CUT:
            starts = [m.start() for m in _UNIT.finditer(text, at, stop) if zlib.crc32(m[0].lower().encode("utf-8", "replace")) % EVERY == 0]
            cuts = sorted({at, *starts, stop})
            out += [(a, b, len(cuts) > 2) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]
        elif n:
            out.append((at, stop, False))
        at = after
    return out


def spans(text: str | None, run: int = 3, least_words: int = 0) -> list[tuple[int, int, int]]:
    """Runs of consecutive sentences: (128-bit hash, first sentence, number of sentences).

    From every sentence: the run of `run` of them whatever its words (or of as many more as make least_words), and shorter runs if they have TWO
    words, one sentence ONE; with a piece of a long sentence in it, a run of any number that makes TWO words. Case and the width of white space don't count.
    """
    import xxhash

    text = text or ""
    wide = not text.isascii() and _WIDE.search(text) is not None
    places = sentences(text)
    words = [text[a:b].lower().split() for a, b, _ in places]
    hashes = [xxhash.xxh3_128_intdigest(" ".join(x)) for x in words]
    counts = [len(_UNIT.findall(text[a:b])) for a, b, _ in places] if wide else list(map(len, words))
    piece = [p for _, _, p in places]
    made = []
    for i in range(len(places)):
        h, n, cut, k = 0, 0, False, 0
        while i + k < len(places):
            h = ((h ^ hashes[i + k]) * 0x9E3779B97F4A7C15F39CC0605CEDC835 + k) & _MASK
            n, cut, k = n + counts[i + k], cut or piece[i + k], k + 1
            whole = k >= run and n >= least_words
            if n >= TWO if cut else whole or n >= (ONE if k == 1 else TWO):
                made.append((h ^ h >> 67, i, k))
                if whole or cut:
                    break
    return made


def without(text: str, hits: list[int]) -> tuple[str, int, int]:
    """The text without the sentences of the spans in hits (first * RUN + number), its sentences, and how many went."""
    places = sentences(text)
    gone = {s for x in hits for s in range(x // RUN, x // RUN + x % RUN)}
    if not gone:
        return text, len(places), 0
    parts, at = [], 0
    for s, (a, _, _) in enumerate(places):
        stop = places[s + 1][0] if s + 1 < len(places) else len(text)  # a sentence goes with the space after it
        if s not in gone:
            parts.append(text[at if not s else a : stop])
        at = stop
    return "".join(parts).strip(), len(places), len(gone)


def remove_repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = 3, least_words: int = 0) -> DataFrame:
    """Columns of df with the cleaned text, n_sentences and n_removed (pieces of long sentences count as sentences).

    Every run of `run` sentences is a span. With least_words, a run with fewer words goes on until it has them: runs of a few one-word sentences, which
    unrelated texts share by chance, then count with what follows them only. Both are below RUN.
    All spans of all texts are hashed and joined by two 63-bit hashes. The first occurrence of a span, by key (null last) and
    place, stays; every sentence that another occurrence covers is removed, in the same text as well. A text gives
    each of its spans once to the join, with the first place; its own repeats are known beforehand. So the join holds a row for each
    text that a repeated span is in, and a passage that one text repeats all over adds none. Hashes are counted with
    map-side aggregation, and only the spans whose hash is repeated go on; the join back splits hot hashes. Null texts stay null; rows equal in key and
    text are one document to each other; an empty table gives no rows; columns with the added names are replaced, all others come back under their own.
    The texts are joined to their hits where they lie while these are few (small()), else both are shuffled.
    """
    assert 1 <= run < RUN and 0 <= least_words < RUN
    df, back = shielded(df, [key, text], "n_sentences", "n_removed")
    row = F.xxhash64(F.lit(6), F.col(key), F.col(text))
    number = F.coalesce(F.col(key).cast("long"), F.lit(_HALF))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only()
        for batch in batches:
            for rows in in_slices(batch):
                made = []
                for k, r, t in zip(rows["k"], rows["row"], rows["t"]):
                    seen: set[int] = set()
                    for h, i, n in spans(t, run, least_words):
                        made.append((h & _HALF, h >> 64 & _HALF, k, r, i * RUN + n, h in seen))
                        seen.add(h)
                columns = list(zip(*made)) or [()] * 6
                yield pd.DataFrame({c: np.array(x, bool if c == "again" else np.int64) for c, x in zip(("h", "g", "k", "row", "at", "again"), columns)}).astype({"at": "int32"})
        give_back()

    every = materialize(df.select(number.alias("k"), row.alias("row"), F.col(text).alias("t")).mapInPandas(cut, "h long, g long, k long, row long, at int, again boolean"), "spans")
    spread, place = every.where("not again").select("h", "g", "k", "row", "at"), F.struct("k", "row")
    repeated = spread.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    repeated = materialize(repeated, "spans")  # as a table of its own, both sides of the join are plain shuffles, which Spark splits where they are skewed
    found = materialize(spread.join(repeated, "h", "left_semi"), "spans")
    first = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    first = materialize(first, "spans")
    later = found.join(first, ["h", "g"]).where(place != F.col("first")).select("k", "row", "at")
    hits = later.unionAll(every.where("again").select("k", "row", "at")).groupBy("k", "row").agg(F.collect_set("at").alias("hits"))
    hits = materialize(hits, "hits")
    discard(every, repeated, found, first)
    if hits.agg(F.coalesce(F.sum(F.size("hits") + 4), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        hits = F.broadcast(hits)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only()
        for batch in batches:
            for rows in in_slices(batch):
                made = [(None, 0, 0) if t is None else without(t, [] if x is None else list(x)) for t, x in zip(rows[text], rows["_hits"])]
                out = rows.drop(columns="_hits")
                out[text] = [m[0] for m in made]
                yield out.assign(n_sentences=[m[1] for m in made], n_removed=[m[2] for m in made]).astype({"n_sentences": "int32", "n_removed": "int32"})
        give_back()

    from pyspark.sql.types import StructType

    kept = others(df, "n_sentences", "n_removed")
    joined = df.select(*kept, number.alias("_k"), row.alias("_row")).join(hits.select(F.col("k").alias("_k"), F.col("row").alias("_row"), F.col("hits").alias("_hits")), ["_k", "_row"], "left").drop("_k", "_row")
    schema = StructType([df.schema[c] for c in kept]).add("n_sentences", "integer").add("n_removed", "integer")
    return back(joined.mapInPandas(clean, schema))
