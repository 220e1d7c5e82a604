"""Packing documents into training sequences by minimum bin slack.

Each document's ids are cut into whole windows of ``capacity`` ids, which are
sequences by themselves, and one remainder.  Remainders wait in a bounded pool
per task; a bin starts with the longest one and a bitset subset-sum over the
pool's length counts finds the multiset that comes closest to the rest of the
window, backtracked to counts.  No shuffle: every task packs what it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text
from .tokens import default_path, encoder

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
POOL = 16_384
#: A bin that stays short by more is cut at powers of two, which need no padding.
MAX_SLACK = 32


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, of largest sum <= capacity.

    Bit ``s`` of the set says that some multiset sums to ``s``.  Counts enter
    as 1, 2, 4, ... copies; the sets before each entry allow backtracking.
    """
    mask, reach = (1 << (capacity + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            copies = min(copies, left)
            layers.append((reach, length, copies))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, copies in reversed(layers):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + copies
            total -= length * copies
    return chosen


def plan_bins(counts: dict[int, int], capacity: int, keep_open: bool = False) -> Iterator[list[int]]:
    """Bins as lists of lengths; ``counts`` is used up.

    With ``keep_open`` it stops before the first bin that is not full.
    """
    while counts:
        longest = max(counts)
        left = dict(counts)
        left[longest] -= 1
        if not left[longest]:
            del left[longest]
        chosen = fill(left, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        if keep_open and sum(n * k for n, k in chosen.items()) < capacity:
            return
        again = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * again
            if not counts[n]:
                del counts[n]
        bin_ = [n for n, k in sorted(chosen.items(), reverse=True) for _ in range(k)]
        for _ in range(again):
            yield bin_


class _Packer:
    """The state of one task."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.pool: dict[int, list[tuple]] = {}
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self.rows.append((doc_id, start, self.capacity, total, self.next_id, 0, ids[4 * start : 4 * (start + self.capacity)]))
            self.next_id += 1
        if whole < total:
            self.pool.setdefault(total - whole, []).append((doc_id, whole, total, ids[4 * whole :]))
            self.waiting += 1

    def flush(self, last: bool) -> None:
        counts = {n: len(v) for n, v in self.pool.items()}
        for bin_ in plan_bins(counts, self.capacity, keep_open=not last):
            pieces = [(n, *self.pool[n].pop()) for n in bin_]
            used = sum(bin_)
            if self.capacity - used > MAX_SLACK:
                room = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
            else:
                room = [self.capacity]
            self._place(pieces, room)
            self.waiting -= len(bin_)
        self.pool = {n: v for n, v in self.pool.items() if v}

    def _place(self, pieces: list[tuple], room: list[int]) -> None:
        """The pieces one after another into sequences of the sizes in ``room``."""
        k, offset = 0, 0
        for n, doc_id, start, total, ids in pieces:
            done = 0
            while done < n:
                take = min(n - done, room[k] - offset)
                self.rows.append((doc_id, start + done, take, total, self.next_id, offset, ids[4 * done : 4 * (done + take)]))
                done, offset = done + take, offset + take
                if offset == room[k]:
                    k, offset, self.next_id = k + 1, 0, self.next_id + 1
        if offset:
            self.next_id += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 7
        self.rows = []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer_path: str | None = None, end_id: int = 0, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Columns read: doc_id, text; others are ignored.  A null text is empty (its
    end id alone); rows with equal or null doc_id are documents of their own;
    an empty table gives no rows.  Sequence ids are unique, not dense: the
    task's number times 2**33 and a count.  Memory: ``pool`` remainders, and
    the ids of the longest text, which is encoded in pieces however long it is.
    A bin that stays short by over ``MAX_SLACK`` ids (the last ones of a task)
    is cut at powers of two, which need no padding.
    """
    path = tokenizer_path or default_path()
    if pool < 1 or capacity < 1:
        raise ValueError("capacity and pool must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), int(end_id).to_bytes(4, "little")
        packer = _Packer(capacity, TaskContext.get().partitionId() << 33)
        held = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode_many(text.as_py() for text in batch.column(1)), strict=True):
                ids += end
                packer.add(doc_id, ids)
                held += len(ids)
                if packer.waiting >= pool:
                    packer.flush(last=False)
                    if packer.waiting > pool // 2:
                        packer.flush(last=True)
                if held >= 1 << 22:
                    yield packer.take()
                    held = 0
        packer.flush(last=True)
        yield packer.take()
        coder.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")).mapInArrow(run, PIECE_SCHEMA)


def piece_ids(ids: bytes) -> np.ndarray:
    """The ids of a piece."""
    return np.frombuffer(ids, "<u4")
