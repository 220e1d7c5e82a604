"""Substring dedup over prefix-partitioned suffix trees.

The suffixes of all texts begin at their words, and what their first 13 words
are decides.  A suffix belongs to the subtree of a *seed* of that prefix: the
run of m words in it whose hash is least.  Seeds have variable length: one
pass counts the suffixes of hashed seeds of the first length, and those that
hold too many are split by the next length, up to the whole 13 words.  Seeds
are dealt to groups that fit in memory.  Neighbouring suffixes mostly share
their seed, so they reach its group together, as one run of words; equal runs
of a group of documents go once, with the smallest document.

A group numbers its words by comparing them and sorts its suffixes by prefix
doubling.  Neighbours in that order with 13 words in common stand below one
internal node of at least that depth; deeper nodes hold subsets of its
suffixes, so this node's smallest document decides for all.  Answers come back
as a bit for each suffix, and in a document the repeats of overlapping windows
join to the maximal ones, which are the spans.  Hashes choose the groups only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_batches, full_text, release_memory
from .words import TextBlock, mix64, number_words, rank_pairs, window_hashes, window_ranks

WINDOW = 13
#: Words of a seed, shortest first; a crowded one is split by the next length, the last by the window itself.
PREFIXES = (4, 7, 10)
#: Counters of hashed seeds at each length: the least, which do up to about 6 TB of text, and the most.
COUNTERS = (1 << 16, 1 << 20)
#: Counters in one row, and tasks whose rows are summed first.
CHUNK, FAN_IN = 1 << 12, 1 << 10
#: Characters of a group of documents, suffixes of a group of seeds, about, and suffixes of a run, at most.
GROUP_CHARS = 6 << 20
GROUP_SUFFIXES = 1 << 19
RUN = 1 << 12
LAST = np.iinfo(np.int64).max

NODE_SCHEMA = "p long, g long, n long, runs binary, owner binary"
REPLY_SCHEMA = "g long, p long, bits binary"
_NODES = pa.schema([("p", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("runs", pa.binary()), ("owner", pa.binary())])
_REPLIES = pa.schema([("g", pa.int64()), ("p", pa.int64()), ("bits", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the seed of ``size`` words of the suffix at each word that has a whole window."""
    least, reach, width = window_hashes(words, size, seed=2), 1, WINDOW - size + 1
    while reach < width and len(least):
        step = min(reach, width - reach)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        reach += step
    return mix64(least ^ np.uint64(size))


def _suffixes(block: TextBlock) -> np.ndarray:
    """The words at which a window of one text begins."""
    n = len(block.numbers) - WINDOW + 1
    return np.flatnonzero(block.text_of[:n] == block.text_of[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _deal(words: np.ndarray, at: np.ndarray, prefixes: int, crowded: list[np.ndarray]) -> np.ndarray:
    """The group of each suffix: that of its shortest seed that is not crowded."""
    p = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for size, full in zip((*PREFIXES, WINDOW), (*crowded, None), strict=True):
        hashed = seeds(words, size)[at[open_]] if len(open_) else np.zeros(0, np.uint64)
        p[open_] = (hashed % np.uint64(prefixes)).astype(np.int64)
        if full is None or not full.any():
            break
        open_ = open_[full[_counter(hashed, len(full))]]
    return p


def _counter(hashed: np.ndarray, counters: int) -> np.ndarray:
    """The counter of a seed: high bits, as the low ones choose the group."""
    return (hashed >> np.uint64(40)).astype(np.int64) & (counters - 1)


def _crowded_prefixes(texts: DataFrame, counters: int, most: int) -> list[np.ndarray]:
    """For each length, which counters of seeds hold over ``most`` suffixes.

    Tasks count into arrays of fixed size and send them in chunks, which are
    summed in two steps, so that a step reads few even if tasks are many; only
    the numbers of the crowded counters come to the driver.
    """
    schema = pa.schema([("level", pa.int32()), ("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(PREFIXES), counters), np.int64)
        for batch in cut_batches(batches, "text", 2 << 20):
            block = TextBlock([t.as_buffer().to_pybytes() for t in batch.column("text")])
            words, at = block.words, _suffixes(block)
            for level, size in enumerate(PREFIXES):
                if len(at):
                    held[level] += np.bincount(_counter(seeds(words, size)[at], counters), minlength=counters)
        part = TaskContext.get().partitionId() // FAN_IN
        chunks = [(level, c // CHUNK, part, held[level, c : c + CHUNK]) for level in range(len(PREFIXES)) for c in range(0, counters, CHUNK)]
        rows = [(level, chunk, part, n.astype("<i8").tobytes()) for level, chunk, part, n in chunks if n.any()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        release_memory()

    def total(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8").reshape(table.num_rows, -1).sum(axis=0)

    def add(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(3, "counts", pa.array([total(table).tobytes()], pa.binary()))

    def choose(table: pa.Table) -> pa.Table:
        counter = np.flatnonzero(total(table) > most) + table.column("chunk")[0].as_py() * CHUNK
        return pa.table({"level": pa.array([table.column("level")[0].as_py()] * len(counter), pa.int32()), "counter": pa.array(counter, pa.int32())})

    kind = "level int, chunk int, part int, counts binary"
    added = texts.select("text").mapInArrow(count, kind).groupBy("level", "chunk", "part").applyInArrow(add, kind)
    out = [np.zeros(counters, bool) for _ in PREFIXES]
    for r in added.groupBy("level", "chunk").applyInArrow(choose, "level int, counter int").toLocalIterator():
        out[r["level"]][r["counter"]] = True
    return out


class _Group:
    """The suffixes of one group of documents, as runs of words."""

    def __init__(self, table: pa.Table, prefixes: int, crowded: list[np.ndarray]):
        rows = zip(table.column("doc_id").to_pylist(), (t.as_buffer().to_pybytes() for chunk in table.column("text").chunks for t in chunk), strict=True)
        # a group is made twice, and Spark gives its rows in another order each time: runs are numbered by this one
        rows = sorted(rows, key=lambda r: (LAST if r[0] is None else r[0], r[1]))
        self.doc_ids, self.raw = [d for d, _ in rows], [t for _, t in rows]
        ids = np.array([LAST if d is None else d for d in self.doc_ids], np.int64)
        self.block = block = TextBlock(self.raw)
        self.at = at = _suffixes(block)
        self.owner = ids[block.text_of[at]]
        p = _deal(block.words, at, prefixes, crowded)
        # a run ends where the next suffix is no neighbour, or of another group, or one too many
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(p) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        new |= (np.arange(len(at)) - np.repeat(begin, size)) % RUN == 0
        self.begin = begin = np.flatnonzero(new)
        self.size = np.diff(np.append(begin, len(at)))
        data = block.data.tobytes()
        first, past = block.offsets[at[begin]].tolist(), block.offsets[at[begin + self.size - 1] + WINDOW].tolist()
        seen: dict[bytes, int] = {}
        self.number = np.fromiter((seen.setdefault(data[i:j], len(seen)) for i, j in zip(first, past, strict=True)), np.int64, len(begin))
        self.runs = list(seen)
        # equal runs are of one group and size
        self.run_p, self.run_size = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        self.run_p[self.number], self.run_size[self.number] = p[begin], self.size
        self.least = np.full(len(seen), LAST)
        np.minimum.at(self.least, self.number, self.owner[begin])
        # by document within a group: their numbers then go as small differences
        self.order = np.lexsort((self.least, self.run_p))
        self.groups, cut = np.unique(self.run_p[self.order], return_index=True)
        self.cut = np.append(cut, len(self.order))

    def nodes(self, g: int) -> Iterator[dict]:
        """The distinct runs of each group of seeds, and the smallest document of each run."""
        pack = zstandard.ZstdCompressor(level=3).compress
        for p, a, b in zip(self.groups.tolist(), self.cut[:-1], self.cut[1:], strict=True):
            some = self.order[a:b]
            runs = b"\n".join([*(self.runs[k] for k in some), b""])
            yield {"p": p, "g": g, "n": int(self.run_size[some].sum()), "runs": pack(runs), "owner": pack(np.diff(self.least[some], prepend=np.int64(0)).astype("<i8").tobytes())}

    def removed(self, replies: dict[int, bytes]) -> list[np.ndarray]:
        """Per document a mask of the words to remove."""
        sizes = self.run_size[self.order]
        ends = np.cumsum(sizes)
        flags = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        bounds = np.append(0, ends)[self.cut]
        for p, a, b in zip(self.groups.tolist(), bounds[:-1], bounds[1:], strict=True):
            if p in replies:
                flags[a:b] = np.unpackbits(np.frombuffer(replies[p], np.uint8), count=int(b - a))
        place = np.empty(len(self.order), np.int64)
        place[self.order] = ends - sizes
        own = flags[np.repeat(place[self.number] - self.begin, self.size) + np.arange(len(self.at))]
        hit = self.at[own | (self.owner > np.repeat(self.least[self.number], self.size))]
        step = np.zeros(len(self.block.numbers) + 1, np.int32)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        covered = np.cumsum(step)[:-1] > 0
        return np.split(covered, np.cumsum(self.block.n_words)[:-1]) if len(self.raw) else []


def subtree(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of each run, suffix order, whether a suffix shares its first 13 words with the one before it in that order).

    ``data`` holds runs of words, a space behind each word and a line feed
    behind each run.  The numbers of ``order`` count the windows of all runs.
    """
    past = np.flatnonzero((data == 32) | (data == 10)) + 1
    numbers, _ = number_words(np.append(0, past), data)
    stop = np.flatnonzero(data[past - 1] == 10)
    windows = np.diff(np.append(-1, stop)) - WINDOW
    first = stop - windows - WINDOW + 1
    ends = np.cumsum(windows)
    at = np.repeat(first - (ends - windows), windows) + np.arange(int(ends[-1]) if len(ends) else 0)
    half = window_ranks(numbers, 8)
    rank = rank_pairs(half[at], half[at + WINDOW - 8])
    order = np.argsort(rank, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = rank[order][1:] == rank[order][:-1]
    return windows, order, same


def _grow(table: pa.Table) -> pa.Table:
    """One group of seeds: which suffixes have a smaller document below their node."""
    rows = table.select(["p", "g", "n", "runs", "owner"]).to_pylist()
    unpack = zstandard.ZstdDecompressor().decompress
    windows, order, same = subtree(np.frombuffer(b"".join(unpack(r["runs"]) for r in rows), np.uint8))
    owner = np.repeat(np.concatenate([np.cumsum(np.frombuffer(unpack(r["owner"]), "<i8")) for r in rows]), windows)
    node = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner[order], node) if len(node) else owner
    earlier = np.empty(len(order), bool)
    earlier[order] = np.repeat(least, np.diff(np.append(node, len(order)))) < owner[order]
    out, a = [], 0
    for r in rows:
        own = earlier[a : a + r["n"]]
        a += r["n"]
        if own.any():
            out.append({"g": r["g"], "p": r["p"], "bits": np.packbits(own).tobytes()})
    release_memory()
    return pa.Table.from_pylist(out, _REPLIES)


def _spans(masks: list[np.ndarray]) -> pa.Array:
    """The ranges of words that each mask covers."""
    starts, ends, cut = [], [], [0]
    for mask in masks:
        step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        starts.append(np.flatnonzero(step == 1))
        ends.append(np.flatnonzero(step == -1))
        cut.append(cut[-1] + len(starts[-1]))
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, ends)]
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["start", "end"])).cast(_SPANS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and spans.

    A word goes if a window of 13 words that covers it also starts in a
    document of smaller doc_id; ``spans`` has the ranges of words that go,
    from ``start`` up to ``end``.  Rows of one doc_id are the same document
    and never remove each other's words; a null doc_id is larger than all
    others.  Null and empty texts have no words; texts of fewer than 13 words
    are left alone, and a text of any length is whole.  Equal rows get equal
    results, an empty table gives no rows.  Columns read: doc_id, text; others
    of any name are ignored.  Memory: a group of documents of about
    ``GROUP_CHARS`` characters (or one longer text), or a group of seeds.
    """
    size = docs.agg(F.sum(F.length(full_text()))).first()[0] or 0
    groups = max(1, -(-size // GROUP_CHARS))
    prefixes = max(1, min((1 << 31) - 1, -(-size // (6 * GROUP_SUFFIXES))))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
    # by the text too: many rows of one doc_id, or without one, are dealt like any others
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    counters = min(COUNTERS[1], max(COUNTERS[0], 1 << (prefixes // 16).bit_length()))
    # a seed of over a quarter of a group is crowded; a counter's usual load, shared by many seeds, is not
    crowded = _crowded_prefixes(dealt, counters, max(GROUP_SUFFIXES // 4, 4 * size // (6 * counters)))

    def send(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(list(_Group(table, prefixes, crowded).nodes(table.column("g")[0].as_py())), _NODES)
        release_memory()
        return out

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", _SPANS)])
        if not table.num_rows:
            return schema.empty_table()
        group = _Group(table, prefixes, crowded)
        masks = group.removed({p.as_py(): bits.as_py() for p, bits in zip(replies.column("p"), replies.column("bits"), strict=True)})
        n_words, n_removed, kept = [], [], []
        for text, mask in zip(group.raw, masks, strict=True):
            words = text.split()
            gone = int(mask.sum())
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(compress(words, ~mask) if gone else words))
        strings = pa.array(kept, pa.binary()).cast(pa.string())
        out = pa.table([pa.array(group.doc_ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), strings, _spans(masks)], schema=schema)
        release_memory()
        return out

    replies = dealt.groupBy("g").applyInArrow(send, NODE_SCHEMA).groupBy("p").applyInArrow(_grow, REPLY_SCHEMA)
    return dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")
