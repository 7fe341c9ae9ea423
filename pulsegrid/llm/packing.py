"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, others
from .tokens import encoder, tokenizer_path

TIERS = (256, 512, 1024, 2048)
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier integer, step_group long"


class Pool:
    """Whole or part documents (index, start) by length, with a bit set for each length held."""

    def __init__(self, longest: int) -> None:
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.held = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.stacks[length].append((doc, start))
        self.held |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        stack = self.stacks[length]
        doc, start = stack.pop()
        if not stack:
            self.held ^= 1 << length
        return doc, start, length

    def longest(self, room: int) -> int:
        """The greatest length held up to room, or 0."""
        return max(0, (self.held & ((2 << room) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.held & -self.held).bit_length() - 1


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (doc, start, length) that hold each token of each document once.

    A document longer than the longest window fills windows of its own; its rest and all others are routed to the shortest
    tier that holds them. Tiers are packed from the longest down: a window opens with the longest document of its
    tier, then takes the longest fitting document of its own or any shorter tier, and what no whole document fits is
    filled with the head of the shortest document left, whose tail goes back to the tier of its length. So every
    window is full; only the last, when nothing is left to fill it, is short. A tier is a range of lengths, so all tiers share one pool.
    """
    longest = tiers[-1]
    pool = Pool(longest)
    out: list[list[tuple[int, int, int]]] = []
    for doc, n in enumerate(lengths):
        rest = n % longest
        out.extend([(doc, start, longest)] for start in range(0, n - rest, longest))
        if rest:
            pool.add(doc, n - rest, rest)
    short: list[list[tuple[int, int, int]]] = []
    for level in range(len(tiers) - 1, -1, -1):
        size, below = tiers[level], tiers[level - 1] if level else 0
        while (first := pool.longest(size)) > below:
            window, room = [pool.take(first)], size - first
            while room and pool.held:
                fits = pool.longest(room)
                if fits:
                    window.append(pool.take(fits))
                    room -= fits
                else:
                    doc, start, length = pool.take(pool.shortest())
                    window.append((doc, start, room))
                    pool.add(doc, start + room, length - room)
                    room = 0
            (short if room else out).append(window)
    # short windows: one for each tier at most; together they make the longest windows, and only the last is padded
    room, window = longest, []
    for doc, start, length in [p for w in short for p in w]:
        while length:
            step = min(room, length)
            window.append((doc, start, step))
            doc, start, length, room = doc, start + step, length - step, room - step
            if not room:
                out.append(window)
                room, window = longest, []
    if window:
        out.append(window)
    return out


class StepGroups:
    """Numbers of training steps: sequences of a size go together, each step holds the same tokens, the last of a size fewer."""

    def __init__(self, tokens_per_step: int) -> None:
        self.tokens_per_step = tokens_per_step
        self.open: dict[int, list[int]] = {}  # size: number and tokens of its last step
        self.n = 0

    def step_of(self, size: int) -> int:
        last = self.open.get(size)
        if last is None or last[1] + size > self.tokens_per_step:
            last = self.open[size] = [self.n, 0]
            self.n += 1
        last[1] += size
        return last[0]


def pack_documents(df: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 1, tiers: tuple[int, ...] = TIERS, tokens_per_step: int = 65_536, tokens_per_round: int = 4_000_000) -> DataFrame:
    """One row for each piece: the columns of df without its text, and start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, tier, step_group, tokens (the piece's ids as little-endian unsigned 32-bit integers).

    A task encodes its rows and packs them in rounds of tokens_per_round, so memory is bounded and nothing is
    shuffled; see pack(). Sequences of a shorter tier are exactly full, all others have the longest tier's size and
    only the last one of a task's round is padded. Step groups go on over a task's rounds, so a task has one group for each tier that isn't
    full. sequence_id and step_group start at the task's number times 2^36 and are unique. Null and empty texts have the end id alone; repeated rows are packed each; columns of df that clash
    with added ones are dropped; an empty table gives no rows.
    """
    from pyspark.sql.types import StructType

    kept = [c for c in others(df, *(x.split()[0] for x in PIECES.split(", ")), "tokens") if c != text]
    schema = StructType([df.schema[c] for c in kept])
    for x in PIECES.split(", "):
        schema = schema.add(*x.split())
    schema = schema.add("tokens", "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        code, base = encoder(tokenizer_path(tokenizer), kind), TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        n_sequences, groups = 0, StepGroups(tokens_per_step)
        held: list[pd.DataFrame] = []
        ids: list[bytes] = []
        total = 0

        def close() -> Iterator[pd.DataFrame]:
            nonlocal n_sequences, total
            rows = pd.concat(held, ignore_index=True)
            sequences = pack([len(x) // 4 for x in ids], tiers)
            sums = [sum(p[2] for p in s) for s in sequences]
            first, n_sequences, total = base + n_sequences, n_sequences + len(sequences), 0

            def pieces() -> Iterator[tuple]:
                for k, (sequence, n) in enumerate(zip(sequences, sums)):
                    at, tier = 0, n if n in tiers else tiers[-1]
                    step = base + groups.step_of(tier)
                    for doc, start, length in sequence:
                        piece = ids[doc][4 * start : 4 * (start + length)]
                        yield doc, start, length, zlib.crc32(piece), len(ids[doc]) // 4, first + k, at, n, tier, step, piece
                        at += length

            made = pieces()
            while some := list(islice(made, 2000)):  # a round's ids are held once, not again as pieces
                out = pd.DataFrame([x[1:] for x in some], columns=[f.name for f in schema.fields[len(kept) :]])
                yield pd.concat([rows.iloc[[x[0] for x in some]].reset_index(drop=True), out], axis=1)
            held.clear()
            ids.clear()

        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.iloc[lo : lo + 500]
                new = [x + end for x in code.encode(list(some[text]))]
                held.append(some[kept])
                ids.extend(new)
                total += sum(map(len, new)) // 4
                if total >= tokens_per_round:
                    yield from close()
        if held:
            yield from close()
        give_back()

    return df.select(*kept, F.col(text)).mapInPandas(run, schema)
