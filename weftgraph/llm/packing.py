"""Hierarchical multi-length packing of documents into token sequences.

Tiers are powers of two up to the window. A document's full windows stand alone; what is left of
it is routed to the smallest tier that holds it. Tiers are packed from the longest down: an item
opens a sequence of its tier, and the gap is filled with the longest item that fits from that or
a shorter tier, at last by cutting one, so every sequence is exactly as long as its tier. Within a
tier, sequences are dealt to step groups of ``step_tokens`` ids each, so that the sum of squared
piece lengths (attention cost) is balanced; only the last group of a tier in a task may be short.

All is done where the documents are read: a task packs the rows of its partition in rounds of
bounded size and carries what is left into the next round; no row is shuffled. What a task has
left at its end fills sequences of the tiers, and what is below the shortest tier is one last
sequence, padded to the window: fewer than ``window`` ids of padding a task. Which rows share a
sequence follows from which rows share a file split, so another split gives another packing; the
same splits, and a task that is run again, give the same one. Rounds keep the order of the rows
they read (``round_tokens`` bounds how far a row moves).

Defined cases: a null text is empty and gives one piece, the end id alone; equal rows are packed
one by one; a null ``doc_id`` is kept; an empty table, or a partition without rows, gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder, vocabulary_path

WINDOW = 1024
TIERS = (1024, 512, 256, 128)
#: Ids of a step group; tokens held by a round of packing; items left for the next round.
STEP_TOKENS = 8192
ROUND_TOKENS = 2_000_000
CARRY_ITEMS = 64
END = (0).to_bytes(4, "little")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Packer:
    """Packs items (document number, start, end) of a task; sequences are numbered from ``base``."""

    def __init__(self, window: int, tiers: tuple[int, ...], step: int, base: int):
        self.window, self.tiers, self.step = window, tuple(sorted((t for t in tiers if t <= window), reverse=True)), step
        self.base, self.made, self.groups = base, 0, 0
        self.stacks: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
        self.mask = 0  # bit n: there is an item of length n
        self.count = 0
        self.out: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}

    def add(self, doc: int, start: int, end: int) -> None:
        n = end - start
        if n >= self.window:
            full = start + n // self.window * self.window
            for at in range(start, full, self.window):
                self._close(self.window, [(doc, at, at + self.window)])
            start, n = full, end - full
        if n:
            self.stacks[n].append((doc, start, end))
            self.mask |= 1 << n
            self.count += 1

    def _take(self, n: int) -> tuple[int, int, int]:
        item = self.stacks[n].pop()
        if not self.stacks[n]:
            self.mask &= ~(1 << n)
        self.count -= 1
        return item

    def _close(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        self.out.setdefault(tier, []).append((self.base + self.made, pieces))
        self.made += 1

    def _fill(self, tier: int, pieces: list[tuple[int, int, int]], gap: int) -> bool:
        """Fills ``gap`` with the longest items that fit, then with a part of one; false if items run out."""
        while gap:
            fits = self.mask & ((1 << (gap + 1)) - 1)
            if fits:
                item = self._take(fits.bit_length() - 1)
            elif self.mask:
                low = (self.mask & -self.mask).bit_length() - 1
                doc, start, end = self._take(low)
                item = (doc, start, start + gap)
                self.add(doc, start + gap, end)
            else:
                break
            pieces.append(item)
            gap -= item[2] - item[1]
        if gap == 0:
            self._close(tier, pieces)
        return gap == 0

    def pack(self, keep: int = CARRY_ITEMS) -> None:
        """Makes sequences until ``keep`` items are left."""
        while self.count > keep:
            n = self.mask.bit_length() - 1
            tier = next((t for t in reversed(self.tiers) if t >= n), self.window)
            item = self._take(n)
            pieces = [item]
            if not self._fill(tier, pieces, tier - n):
                for p in pieces:
                    self.add(*p)
                return

    def finish(self) -> None:
        """Packs all that is left: full sequences of falling tiers, then one short sequence of the window's tier."""
        self.pack(0)
        rest = [p for n in range(1, self.window + 1) for p in self.stacks[n]]
        total = sum(e - s for _, s, e in rest)
        self.stacks, self.mask, self.count = [[] for _ in range(self.window + 1)], 0, 0
        while total:
            tier = next((t for t in self.tiers if t <= total), 0)
            gap = size = tier or total
            pieces = []
            while gap:
                doc, start, end = rest.pop()
                n = min(gap, end - start)
                pieces.append((doc, start, start + n))
                if start + n < end:
                    rest.append((doc, start + n, end))
                gap -= n
            self._close(tier or self.window, pieces)
            total -= size

    def drain(self, last: bool) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(tier, step group, sequence, pieces) of what has been made, dealt to balanced groups.

        Sequences that don't fill a group wait for the next round, unless it is the ``last``.
        """
        waiting: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}
        for tier, made in self.out.items():
            per = max(1, self.step // tier)
            full = len(made) // per * per
            groups = full // per
            dealt = sorted(made[:full], key=lambda x: (-sum((e - s) ** 2 for _, s, e in x[1]), x[0]))
            for i, (seq, pieces) in enumerate(dealt):
                lap, at = divmod(i, groups)
                yield tier, self.base + self.groups + (groups - 1 - at if lap % 2 else at), seq, pieces
            self.groups += groups
            if last and made[full:]:
                yield from ((tier, self.base + self.groups, seq, pieces) for seq, pieces in made[full:])
                self.groups += 1
            elif made[full:]:
                waiting[tier] = made[full:]
        self.out = waiting

    def used(self) -> set[int]:
        """Documents that items or waiting sequences still refer to."""
        waiting = (p[0] for made in self.out.values() for _, pieces in made for p in pieces)
        return {d for stack in self.stacks for d, _, _ in stack}.union(waiting)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """Pieces of the packed documents; see ``SCHEMA``. Sequence and group numbers are unique to a task."""
    if window & (window - 1) or any(t & (t - 1) for t in tiers):
        raise ValueError("window and tiers must be powers of two")
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids = encoder(vocabulary)
        packer = Packer(window, tiers, step_tokens, TaskContext.get().partitionId() << 40)
        held: dict[int, tuple[object, bytes]] = {}
        number = tokens = 0

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            rows = [
                (held[d][0], s, e - s, zlib.crc32(held[d][1][4 * s : 4 * e]), len(held[d][1]) // 4, seq, tier, group)
                for tier, group, seq, pieces in packer.drain(last)
                for d, s, e in pieces
            ]
            for d in held.keys() - packer.used():
                del held[d]
            if not rows:
                return
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "tier", "step_group"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["offset"] = out.groupby("sequence_id", sort=False)["length"].cumsum() - out["length"]
            yield out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]]

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                got = ids.encode(text) + END
                held[number] = (doc_id, got)
                packer.add(number, 0, len(got) // 4)
                number += 1
                tokens += len(got) // 4
                if tokens >= round_tokens:
                    packer.pack()
                    tokens = 0
                    yield from flush(False)
        packer.finish()
        yield from flush(True)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInPandas(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
