"""Hierarchical packing of documents into training sequences of several context sizes.

A document first fills whole windows of the longest size by itself; what is left of it is
routed to the smallest tier that holds it. Tiers are packed from the longest on: a window
is opened with the longest rest of its tier, then filled with the longest rests of its own
or shorter tiers that fit; the last gap takes a cut from the shortest rest at hand. So every
window of a tier is full, and a tier's size being a power of two it needs no padding; only
what a task has left at its end is shorter. Windows of a tier are dealt to step groups that
hold the same number of tokens and about the same attention cost.

Packing happens where the texts are read: no shuffle, memory bounded by a pool of rests.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, table, text_or_empty
from .tokens import MEMO, encoder, id_lists, pieces_of

TIERS = (256, 512, 1024, 2048)


class TierPacker:
    """Packs (document, length) pairs; ``take`` gets windows of (tier, step, [(document, start, length), ...])."""

    def __init__(self, tiers=TIERS, step_tokens: int = 16384, pool_tokens: int = 1 << 18):
        self.tiers = sorted(tiers)
        self.longest = self.tiers[-1]
        self.step_tokens, self.pool_tokens = max(step_tokens, self.longest), pool_tokens
        self.rests: list[tuple[int, int, int]] = []  # (length, document, start), ascending
        self.pooled = 0
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.steps = 0

    def add(self, doc: int, n: int):
        start = 0
        while n - start >= self.longest:
            self.waiting[self.longest].append([(doc, start, self.longest)])
            start += self.longest
        if n > start:
            insort(self.rests, (n - start, doc, start))
            self.pooled += n - start
        if self.pooled >= self.pool_tokens:
            self._pack()
        return self._steps()

    def _pack(self):
        for tier in reversed(self.tiers):
            below = max([t for t in self.tiers if t < tier], default=0)
            while self.rests and self.rests[-1][0] > below and self.pooled >= tier:
                self._window(tier)

    def _window(self, tier: int):
        """A full window; the pool holds at least its tokens."""
        window, gap = [], tier
        while gap:
            k = bisect_right(self.rests, (gap, float("inf"), 0)) - 1
            length, doc, start = self.rests.pop(k if k >= 0 else 0)
            used = min(length, gap)
            if length > used:
                insort(self.rests, (length - used, doc, start + used))
            window.append((doc, start, used))
            gap -= used
            self.pooled -= used
        self.waiting[tier].append(window)

    def _steps(self, final: bool = False):
        out = []
        for tier, windows in self.waiting.items():
            each = max(1, self.step_tokens // tier)
            groups = -(-len(windows) // each) if final else len(windows) // each
            if not groups or not final and len(windows) < 4 * each:
                continue
            ready, self.waiting[tier] = (windows, []) if final else (windows[: groups * each], windows[groups * each :])
            ready.sort(key=lambda w: -sum(n * n for _, _, n in w))
            for k, window in enumerate(ready):  # there and back, so that costs even out
                turn, place = divmod(k, groups)
                out.append((tier, self.steps + (place if turn % 2 == 0 else groups - 1 - place), window))
            self.steps += groups
        return out

    def finish(self):
        self._pack()
        for tier in reversed(self.tiers):
            while self.pooled >= tier:
                self._window(tier)
        out = self._steps(final=True)
        if self.rests:
            out.append((self.longest, self.steps, [(d, s, n) for n, d, s in reversed(self.rests)]))
            self.rests, self.pooled, self.steps = [], 0, self.steps + 1
        return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, *, key: str = "doc_id", tiers=TIERS, step_tokens: int = 16384, digest: bool = False, memo: int = MEMO) -> DataFrame:
    """One row per piece: ``key``, start, length, doc_tokens, sequence_id, offset, tier, step_group
    and the piece's ids, or with ``digest`` their crc32 (little-endian unsigned 32-bit) in their place.

    Null and empty texts are the end id alone; equal keys are packed as documents of their
    own; no rows give no rows; texts of any length are cut at sequence ends; other columns are
    ignored, whatever their names. Step groups are balanced within a task, which packs what it
    reads; its last group of each tier may hold fewer sequences. A sequence shorter than its tier is to be padded to it.
    """
    last, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, start long, length long, {last} {kind}, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    arrow_key = None

    def run(batches):
        nonlocal arrow_key
        encode, end = encoder(vocabulary, memo), end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36
        packer, ids, names, sequence = TierPacker(tiers, step_tokens), {}, {}, 0
        left: dict[int, int] = {}
        seen = 0

        def rows(windows):
            nonlocal sequence
            cols: list[list] = [[] for _ in range(9)]
            for tier, step, window in windows:
                offset = 0
                for doc, start, n in window:
                    raw = ids[doc][4 * start : 4 * (start + n)]
                    got = (names[doc], start, n, zlib.crc32(raw) if digest else raw, len(ids[doc]) // 4, base + sequence, offset, tier, base + step)
                    for col, x in zip(cols, got):
                        col.append(x)
                    offset += n
                    left[doc] -= n
                    if not left[doc]:
                        del ids[doc], names[doc], left[doc]
                sequence += 1
            types = [arrow_key, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [id_lists(c) if k == 3 and not digest else pa.array(c, t) for k, (c, t) in enumerate(zip(cols, types))]
            return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", last, "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in pieces_of(batches):
            arrow_key = batch.schema.field(0).type
            ready = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids[seen], names[seen] = encode(text) + end, name
                left[seen] = len(ids[seen]) // 4
                ready += packer.add(seen, left[seen])
                seen += 1
            if ready:
                yield rows(ready)
        if seen:
            yield rows(packer.finish())

    return docs.select(key, text_or_empty().alias("text")).mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in word-level ids with end id 1, packed into sequences of up to 2048."""
    bounded_batches(spark)
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, digest=True)


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
