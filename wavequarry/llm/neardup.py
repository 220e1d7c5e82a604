"""N-gram Jaccard join with Bayesian pruning.

Equal word sequences are one node.  MinHash bands propose: nodes that share
one form a component.  Their signatures meet, block by block; MinHash values
are compared a few at a time and a pair is dropped once its posterior
probability of reaching the threshold is below the tolerance.  What is left
falls into smaller components, and only within these the texts meet, each sent
once to the task (or, for a large component, to the block pairs) that compares
it: shingles are numbered there by their words, so the similarity is exact.
Tasks give back counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_batches, discard, full_text, materialize, release_memory, spread_join, store
from .components import connected_components, spanning_roots
from .words import TextBlock, mix64

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-5
#: A pair at 0.8 shares no band with probability (1 - 0.8**5)**25 < 5e-5.
BANDS, ROWS = 25, 5
HASHES = 128
STEP = 16
#: Texts of a block of a large component, at most about; bytes of text that meet in one task, about.
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Signatures that meet in one task, about.
SIGNATURES = 4096

_RANDOM = np.random.default_rng(7_919)
_FACTORS = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(shingles: list[np.ndarray]) -> np.ndarray:
    """(texts, HASHES) MinHash values; zeros for texts without shingles."""
    out = np.zeros((len(shingles), HASHES), np.uint32)
    full = [k for k, s in enumerate(shingles) if len(s)]
    if full:
        low = (np.concatenate([shingles[k] for k in full]) >> np.uint64(16)).astype(np.uint32)
        at = np.cumsum([0] + [len(shingles[k]) for k in full[:-1]])
        for h in range(HASHES):
            out[full, h] = np.minimum.reduceat(low * _FACTORS[h] + _SHIFTS[h], at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; a band's number is part of its key."""
    grouped = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return out.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): below, a pair is dropped.

    With a uniform prior the similarity given m matches of k is Beta(m + 1,
    k - m + 1); its mass above t is P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append((k, m))
    return out


def prune(signature: np.ndarray, left: np.ndarray, right: np.ndarray, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs that the rules leave."""
    matches, begin = np.zeros(len(left), np.int32), 0
    for k, needed in rules:
        matches += (signature[left, begin:k] == signature[right, begin:k]).sum(axis=1, dtype=np.int32)
        ok = matches >= needed
        left, right, matches, begin = left[ok], right[ok], matches[ok], k
    return left, right


def _intersections(shingles: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of each pair.  Many pairs of few texts go through a product of incidence matrices."""
    used = np.unique(np.concatenate([left, right])) if len(left) else np.zeros(0, int)
    if len(left) < 8 * len(used) or not len(left):
        return np.array([len(np.intersect1d(shingles[a], shingles[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    sizes = [len(shingles[k]) for k in used]
    _, column, count = np.unique(np.concatenate([shingles[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), sizes)
    shared, everywhere = count > 1, count == len(used)
    part = shared & ~everywhere
    place = np.cumsum(part) - 1
    keep = part[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    # a product's 4096 columns are exact in float32, their sum over any number of products in int64
    common = np.full((len(used), len(used)), int(everywhere.sum()), np.int64)
    for begin in range(0, int(part.sum()), 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        matrix = np.zeros((len(used), 4096), np.float32)
        matrix[row[a:b], column[a:b] - begin] = 1
        common += (matrix @ matrix.T).astype(np.int64)
    back = np.searchsorted(used, np.stack([left, right]))
    return common[back[0], back[1]]


def candidate_pairs(signature: np.ndarray, side: np.ndarray | None = None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band and that the pruning rules leave.

    With ``side`` only pairs of different sides are looked at.
    """
    keys, rules, n, found = band_keys(signature), least_matches(threshold), len(signature), []
    for begin in range(0, n, 128):
        some = np.arange(begin, min(begin + 128, n))
        meet = np.zeros((len(some), n), bool)
        for b in range(BANDS):
            meet |= keys[some, b][:, None] == keys[:, b][None, :]
        meet &= np.arange(n)[None, :] > some[:, None]
        if side is not None:
            meet &= side[some][:, None] != side[None, :]
        a, b = np.nonzero(meet)
        found.append(prune(signature, some[a], b, rules))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def linked_pairs(texts: list[bytes], side: np.ndarray | None = None, threshold: float = THRESHOLD, signature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of texts whose Jaccard similarity, by their words, is at least ``threshold``.

    Texts without words are in no pair.
    """
    block = TextBlock(texts)
    if signature is None:
        signature = signatures(block.shingles(SHINGLE))
    left, right = candidate_pairs(signature, side, threshold)
    full = block.n_words > 0
    ok = full[left] & full[right]
    left, right = left[ok], right[ok]
    if not len(left):
        return left, right
    shingles = block.exact_shingles(SHINGLE)
    sizes = np.array([len(s) for s in shingles])
    common = _intersections(shingles, left, right)
    ok = common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9
    return left[ok], right[ok]


def _identified(docs: DataFrame, key: str = "row_key", text_hash: str = "text_hash") -> DataFrame:
    """Two columns more that name a row; equal rows share them."""
    text = full_text()
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))).withColumn(text_hash, F.xxhash64(text))


def node_name(text: bytes) -> bytes:
    """The name that texts of equal word sequences share."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _sketch(rows: DataFrame) -> DataFrame:
    """row_key, text_hash, doc_id, node, number, size (bytes of text) and signature; null where there is no word.

    ``number`` is the first half of the node's name.  Candidates are found by
    it: two nodes that shared it would only be compared in vain.
    """
    schema = "row_key long, text_hash long, doc_id long, node binary, number long, size long, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", 2 << 20):
            raw = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            shingles = TextBlock(raw).shingles(SHINGLE)
            signs = [x.tobytes() if len(s) else None for x, s in zip(signatures(shingles), shingles, strict=True)]
            nodes = [node_name(t) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("text_hash"), batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in nodes], pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array(signs, pa.binary())],
                ["row_key", "text_hash", "doc_id", "node", "number", "size", "signature"],
            )
        release_memory()

    return rows.select("row_key", "text_hash", F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")).mapInArrow(run, schema)


def _bands(nodes: DataFrame) -> DataFrame:
    """(number, key) of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("signature").is_valid())
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                keys = band_keys(_signatures(part.column("signature")))
                rows = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([part.column("number").take(rows), pa.array(keys.reshape(-1))], ["number", "key"])

    return nodes.select("number", "signature").mapInArrow(run, "number long, key long")


def _signatures(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, HASHES)


def _forest(meet):
    """The function of a group of members: node, local_root, links and ``whole`` of each.

    ``meet(table, rows, sides)`` gives the linked pairs of a component.  One
    of one part is ``whole``; of larger ones the group holds one part, or two
    whose members meet.
    """
    kinds = pa.schema([("node", pa.binary()), ("local_root", pa.binary()), ("links", pa.int64()), ("whole", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kinds.empty_table()
        # equal rows share a node: the first row of each stands for it
        table = table.take(pa.array(np.unique(np.array(table.column("node").to_pylist(), object), return_index=True)[1]))
        node, root = (table.column(c).to_pylist() for c in ("node", "root"))
        part, copies = (table.column(c).to_numpy() for c in ("part", "copies"))
        cross = table.column("g2")[0].as_py() not in (-1, table.column("g1")[0].as_py())
        whole = table.column("parts")[0].as_py() == 1
        groups: dict[bytes, list[int]] = {}
        for k, r in enumerate(root):
            groups.setdefault(r, []).append(k)
        links, local = np.zeros(len(node), np.int64), np.arange(len(node))
        for group in map(np.array, groups.values()):
            left, right = meet(table, pa.array(group), part[group] if cross else None)
            np.add.at(links, group[left], copies[group[right]])
            np.add.at(links, group[right], copies[group[left]])
            local[group] = group[spanning_roots(len(group), left, right)]
        release_memory()
        return pa.table([pa.array(node, pa.binary()), pa.array([node[k] for k in local], pa.binary()), pa.array(links), pa.array([whole] * len(node))], schema=kinds)

    return run


def _dealt(members: DataFrame, bundles: int) -> DataFrame:
    """Members with ``large``, ``g1`` and ``g2``: the tasks in which they meet.

    Small components share ``bundles`` tasks; a large one has a task for each
    pair of its parts, and a member goes to those of its own part.
    """
    single = F.col("parts") == 1
    members = members.select("*", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.expr("sequence(0, parts - 1)"))).alias("other"))
    return members.select(
        "*", F.when(~single, F.col("root")).alias("large"),
        F.when(single, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.least("part", "other")).cast("long").alias("g1"),
        F.when(single, F.lit(-1)).otherwise(F.greatest("part", "other")).cast("long").alias("g2"),
    ).drop("other")


def _placed(members: DataFrame, nodes: DataFrame, key: str, parts) -> tuple[DataFrame, int, int]:
    """Members (m, root) of components of several, with the columns of the node whose ``key`` is m, and their part; their count and bytes."""
    members = members.join(nodes, F.col("m") == F.col(key)).drop("m")
    sizes = members.groupBy(F.col("root").alias("of")).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes")).where("members > 1")
    sizes = sizes.withColumn("parts", F.ceil(parts).cast("int"))
    count, held = sizes.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    placed = spread_join(members, "root", sizes.select("of", "members", "parts"), "of", "members", count).drop("of", "members")
    return materialize(placed.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "placed"), count, held


def _joined_roots(found: DataFrame) -> DataFrame:
    """(node, root) by the forests of all tasks."""
    roots = found.where("whole").select("node", F.col("local_root").alias("root"))
    split = found.where((~F.col("whole")) & (F.col("node") != F.col("local_root"))).select(F.col("node").alias("a"), F.col("local_root").alias("b")).distinct()
    return roots if split.isEmpty() else roots.union(connected_components(split))


FOREST = "node binary, local_root binary, links long, whole boolean"


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: row_key, text_hash, doc_id, class (its name), class_id, n_links.

    A link joins two rows whose sets of five-word shingles have a Jaccard
    similarity of at least ``threshold``; n_links counts a row's partners,
    copies included, and class_id is the smallest doc_id that links lead to.
    Rows of equal words, blank ones included, are copies.  A text of fewer
    than five words has one shingle of all its words.  Null texts are empty;
    rows without doc_id take part, and a class of them alone has a null id.
    An empty table gives no rows; columns other than doc_id and text are not
    read.  Whole texts of any length are compared, one of over ``BLOCK_BYTES``
    in a task with few others.  A pair at the threshold is missed with a
    probability of about 1e-4 (no common band, or pruned).
    """
    spark = docs.sparkSession
    rows = _identified(docs.select("doc_id", "text"))
    sketch, sketch_path = store(_sketch(rows), "sketch")
    nodes = sketch.groupBy("node").agg(F.min(F.struct("row_key", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("number").alias("number"), F.first("size").alias("size"))
    nodes = materialize(nodes.select("node", "number", "copies", "least", "size", F.col("rep.row_key").alias("k"), F.col("rep.text_hash").alias("h")), "nodes")
    keys = _bands(sketch)
    hubs = keys.groupBy(F.col("key").alias("hub_key")).agg(F.min("number").alias("hub"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last").drop("last")
    edges = spread_join(keys, "key", hubs, "hub_key", "n", BANDS * sketch.count(), merge=True).where("number <> hub")
    edges = materialize(edges.select(F.col("number").alias("a"), F.col("hub").alias("b")).distinct(), "candidates")
    plain = nodes.select("node", "copies", "least")
    named = sketch.select("row_key", "text_hash", "doc_id", "node")
    if edges.isEmpty():
        classed = plain.select("node", "least", F.col("node").alias("class"), "copies", (F.col("copies") - 1).alias("n_links"))
    else:
        known = nodes.drop("least")
        placed, count, _ = _placed(connected_components(edges).withColumnRenamed("node", "m"), known, "number", F.col("members") / F.least(F.lit(8 * block), F.greatest(F.lit(block), F.col("members") / 32)))
        same = (F.col("row_key") == F.col("k")) & (F.col("text_hash") == F.col("h")) & (F.col("node") == F.col("of_node"))
        signed = sketch.select("row_key", "text_hash", F.col("node").alias("of_node"), "signature").join(placed.hint("merge"), same)
        meet = _dealt(signed.select("node", "root", "parts", "part", "copies", "signature"), max(1, -(-count // SIGNATURES)))
        left = _forest(lambda table, at, side: candidate_pairs(_signatures(table.column("signature").take(at)), side, threshold))
        pruned = materialize(meet.groupBy("large", "g1", "g2").applyInArrow(left, FOREST), "pruned")
        named, sketch_path = _slim(spark, named, sketch_path)
        placed, _, held = _placed(_joined_roots(pruned).withColumnRenamed("node", "m"), known, "node", F.greatest(F.col("members") / block, F.least("members", F.col("bytes") / BLOCK_BYTES)))
        texts = rows.select("row_key", "text_hash", full_text().alias("text"))
        # equal rows, and in theory others of equal hashes, come with one key: those of another name go
        members = texts.join(placed.hint("merge"), (F.col("row_key") == F.col("k")) & (F.col("text_hash") == F.col("h"))).select("node", "root", "parts", "part", "copies", "text")
        members = _dealt(_named(members), max(1, -(-held // BLOCK_BYTES)))
        exact = _forest(lambda table, at, side: linked_pairs([t.as_buffer().to_pybytes() for t in table.column("text").take(at)], side, threshold))
        compared = materialize(members.groupBy("large", "g1", "g2").applyInArrow(exact, FOREST), "compared")
        links = compared.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
        roots = _joined_roots(compared).select(F.col("node").alias("r_node"), F.col("root").alias("class"))
        classed = (
            plain.join(links, F.col("node") == F.col("l_node"), "left")
            .join(roots, F.col("node") == F.col("r_node"), "left")
            .select("node", "least", F.coalesce("class", "node").alias("class"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        )
    classed = materialize(classed, "classed")
    ids = classed.groupBy(F.col("class").alias("c")).agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("nodes"))
    classes = spread_join(classed, "class", ids, "c", "nodes", classed.count()).select(F.col("node").alias("c_node"), "class", "class_id", "n_links", "copies")
    # the copies of one text may be many: such nodes are joined by broadcast
    return spread_join(named, "node", classes, "c_node", "copies", named.count()).select("row_key", "text_hash", "doc_id", "class", "class_id", "n_links")


def _slim(spark, named: DataFrame, path: str) -> tuple[DataFrame, str]:
    """The names of rows as a table of their own, in place of the one with signatures."""
    out = store(named, "named")
    discard(spark, path)
    return out


def _named(members: DataFrame) -> DataFrame:
    """Members whose text has the name of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = [node_name(t.as_buffer().to_pybytes()) == n.as_py() for t, n in zip(batch.column("text"), batch.column("node"), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_()))

    return members.mapInArrow(run, members.schema)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, rows without one last.

    Of equal rows one stays.  Columns of any name are kept, those that begin
    with ``__neardup_`` aside.
    """
    classes = materialize(near_duplicate_classes(docs, threshold), "classes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "row_key", "text_hash"))
    kept = classes.groupBy(F.col("class").alias("c")).agg(least.alias("kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # joined by shuffle at any size, as they may be most of the table
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "row_key", "text_hash")
    several = spread_join(classes.withColumn("own", own), "class", kept, "c", "rows", classes.count())
    gone = materialize(several.where("own <> kept").select(F.col("row_key").alias("k_row"), F.col("text_hash").alias("k_hash")).distinct(), "gone")
    key, text_hash = "__neardup_row_key", "__neardup_text_hash"
    same = (F.col(key) == F.col("k_row")) & (F.col(text_hash) == F.col("k_hash"))
    rows = _identified(docs, key, text_hash).join(gone.hint("merge"), same, "left_anti")
    repeated = classes.groupBy("row_key", "text_hash").count().where("count > 1")
    if not repeated.isEmpty():
        again = repeated.select(F.col("row_key").alias("k_row"), F.col("text_hash").alias("k_hash"))
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key, text_hash]))
    return rows.select(*docs.columns)
