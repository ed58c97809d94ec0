"""N-gram Jaccard join: a MinHash LSH forest with adaptive prefixes, then exact verification.

Documents with the same set of word shingles are one class; a class takes part once.

Signature: one-permutation MinHash of the shingles, empty bins filled by densification.
Forest: each tree labels a class with DEPTH bins; equal prefixes of labels are a node of the
tree's trie. Matching starts at the nodes of the shortest prefix that is worth it. Nodes of
at most CROWD classes are matched as they are; in a crowded one a class follows its label to
longer prefixes, until few share it or the label ends. Then prefixes are shortened again:
the chance to find a pair at the threshold follows from the depths a class has in all
trees, and as long as it is under the target recall the class gives up the longest prefix
in the tree where the shorter one is least crowded. A node that one class gives up to is
matched for all its classes, so both ends of a pair use the same node and the target holds
for each class. Tries are never gathered: nodes are known by hashes of prefixes, counted
with partial sums and looked up without a hot task.

Candidates: classes of a matched node whose one-bit sketches don't differ too much. Members
are linked to the node's smallest; that stands for all pairs as long as every sketch agrees
with the smallest one's. Where one doesn't, the others' sketches are compared pair by pair,
in blocks, and each block gives one edge per member. So two classes that share a
node and look alike always meet in a component of candidates, whoever else is in the node.

Verification: a component is dealt to blocks by hash and each pair of blocks to a task,
which computes the exact Jaccard similarity of all its pairs as a matrix product. Pairs
are never rows: a task returns, per class, how many links it has and one edge to the
smallest class that links within the task lead to. So a class's links are all counted, however large
its group is, and no component meets in one task.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .pretokens import strings, text_blocks
from .shared import materialise
from .skew import attach

N_WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 32, 8
RECALL = 0.9994
BINS = TREES * DEPTH
#: Candidates must look at least this similar by their sketches, and less if it is within so many standard errors of the threshold.
SKETCH_LEAST, SKETCH_ERRORS = 0.5, 6
#: A node of more classes is crowded.
CROWD = 32
#: Classes in a block of a component, and bytes of their texts.
BLOCK, BLOCK_BYTES = 384, 32_000_000
#: Up to so many shingles, sets are told apart by their words. Among many short texts 64-bit hashes would meet by chance.
FEW_SHINGLES = 16
#: Classes in a block of a node whose sketches are compared pair by pair.
PREFIX_BLOCK = 2048
#: Entries of a dense block of the verification's matrices.
DENSE = 8_000_000
#: Bytes and rows of text signed at a time.
SIGN_BYTES, SIGN_ROWS = 1_500_000, 2000
_FILL_TRIES = 48
_WORDS = [f"sketch{k}" for k in range(BINS // 64)]
_SKETCH = [*_WORDS, "allowed"]


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, up to ``depth``, that finds a pair at the threshold with probability ``recall`` if all trees use it."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shingles(lists: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of all shingles, sorted and distinct. A document of fewer than n words has one, of all its words."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    codes, distinct = pd.factorize(np.array(list(itertools.chain.from_iterable(lists)), dtype=object))
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    word = table[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    docs, hashes = [], []
    with np.errstate(over="ignore"):
        factor = [_mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(n)]
        if len(word) >= n:
            rolled = sum((word[k : len(word) - n + 1 + k] * factor[k] for k in range(n)), np.zeros(len(word) - n + 1, np.uint64))
            doc = np.repeat(np.arange(len(lists)), sizes)[: len(rolled)]
            inside = np.arange(len(rolled)) + n <= ends[doc]
            docs.append(doc[inside])
            hashes.append(_mix(rolled[inside]))
        for d in np.flatnonzero((sizes < n) & (sizes > 0)):
            own = word[starts[d] : ends[d]]
            docs.append(np.array([d]))
            hashes.append(_mix(np.array([sum((own[k] * factor[k] for k in range(len(own))), np.uint64(len(own)))], np.uint64)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


_FILL = np.random.default_rng(20).integers(0, BINS, (_FILL_TRIES, BINS))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """documents x BINS of MinHash values; a document without shingles has _EMPTY throughout."""
    sig = np.full(n_docs * BINS, _EMPTY)
    np.minimum.at(sig, doc * BINS + (h >> np.uint64(56)).astype(np.int64) % BINS, h & np.uint64((1 << 56) - 1))
    sig = sig.reshape(n_docs, BINS)
    filled = sig != _EMPTY
    d, b = np.nonzero(~filled & filled.any(1)[:, None])
    for t in range(_FILL_TRIES):
        if not len(d):
            break
        source = _FILL[t][b]
        ok = filled[d, source]
        sig[d[ok], b[ok]] = sig[d[ok], source[ok]]
        d, b = d[~ok], b[~ok]
    # What is left takes the next filled bin.
    source = b.copy()
    while len(d):
        source = (source + 1) % BINS
        ok = filled[d, source]
        sig[d[ok], b[ok]] = sig[d[ok], source[ok]]
        d, b, source = d[~ok], b[~ok], source[~ok]
    return sig


def allowed_bits(filled: np.ndarray, threshold: float) -> np.ndarray:
    """How many bits the sketch of a document with so many filled bins may differ in from one at the threshold.

    The standard error is 0.04 at a threshold of 0.8 with all bins filled; bins that are
    copies add nothing, so the fewer shingles a document has, the more may differ.
    """
    filled = np.maximum(filled, 1)
    copies = BINS / filled
    independent = filled * copies**2 / (copies**2 + copies - 1)
    error = np.sqrt((1 - threshold**2) / independent)
    return np.floor((1 - np.minimum(SKETCH_LEAST, threshold - SKETCH_ERRORS * error)) * BINS / 2).astype(np.int64)


def _digest(words: list[str], h: np.ndarray, n: int) -> bytes:
    """Of a shingle set, the same for equal sets only."""
    if len(h) <= FEW_SHINGLES:
        shingles = {" ".join(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))}
        return hashlib.blake2b("\n".join(sorted(shingles)).encode("utf-8", "surrogatepass"), digest_size=16, person=b"words").digest()
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def digests(texts: list[str | None], n: int) -> list[bytes]:
    lists = [split_words(t) for t in texts]
    doc, h = _shingles(lists, n)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [_digest(w, h[a:b], n) for w, a, b in zip(lists, cuts[:-1], cuts[1:], strict=True)]


def forest_rows(texts: list[str | None], n: int, depth: int, threshold: float = THRESHOLD) -> pa.RecordBatch:
    """Per text: the digest of its shingle set, its prefix of ``depth`` bins in each tree and the two bins behind, its sketch and how many bits may differ from it."""
    lists = [split_words(t) for t in texts]
    doc, h = _shingles(lists, n)
    sig = signatures(doc, h, len(texts))
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    digest = [_digest(w, h[a:b], n) for w, a, b in zip(lists, cuts[:-1], cuts[1:], strict=True)]
    with np.errstate(over="ignore"):
        label = sig.reshape(len(texts), TREES, DEPTH)
        prefix = np.zeros(label.shape[:2], np.uint64) + np.arange(TREES, dtype=np.uint64)
        for k in range(depth):
            prefix = _mix(prefix * np.uint64(0x9E3779B97F4A7C15) + label[:, :, k])
        # Half a word for each of the next two bins; a label that has ended goes on with zeros.
        behind = [_mix(label[:, :, k]) >> np.uint64(32) if k < DEPTH else np.zeros_like(prefix) for k in (depth, depth + 1)]
        tail = behind[0] << np.uint64(32) | behind[1]
        bits = (_mix(sig) & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    filled = np.zeros(len(texts) * BINS, bool)
    filled[doc * BINS + (h >> np.uint64(56)).astype(np.int64) % BINS] = True
    allowed = allowed_bits(filled.reshape(-1, BINS).sum(1), threshold)
    names = ["digest", "prefixes", "tails", *_SKETCH]
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).reshape(-1)), TREES).cast(pa.list_(pa.int64()))
    columns = [pa.array(digest, pa.binary()), lists(prefix), lists(tail), *(pa.array(sketch[:, k]) for k in range(BINS // 64)), pa.array(allowed)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def sign(docs: DataFrame, n: int, depth: int, threshold: float = THRESHOLD) -> DataFrame:
    """``id, h, bytes`` of every row as they are, and what :func:`forest_rows` says of its ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(3), SIGN_BYTES):
                for c in range(0, len(block), SIGN_ROWS):
                    texts = strings(block.slice(c, SIGN_ROWS))
                    made = forest_rows(texts, n, depth, threshold)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(texts)) for k in range(3)), *made.columns], names=["id", "h", "bytes", *made.schema.names])
                    at += len(texts)

    rows = docs.select("id", "h", "bytes", "text")
    fields = ", ".join(["digest binary", "prefixes array<bigint>", "tails array<bigint>", *(f"{s} bigint" for s in _SKETCH)])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *T._parse_datatype_string(fields).fields]))


def _lowest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest of ``ids`` that each one's links lead to; ``linked`` is symmetric."""
    lowest, most = ids.copy(), ids.max()
    while True:
        before = lowest.copy()
        lowest = np.minimum(lowest, np.where(linked, lowest[None, :], most).min(1))
        if (lowest == before).all():
            return lowest


def _alike(ids: np.ndarray, block: np.ndarray, sketches: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Per member of a cell, the smallest that agreeing sketches lead to; a cell is one block, or the pairs between two."""
    signs = np.unpackbits(sketches.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    linked = BINS - signs @ signs.T <= 2 * np.maximum(allowed[:, None], allowed[None, :])
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    return _lowest(linked, ids)


def _crowd_edges(members: DataFrame) -> DataFrame:
    """``a, b`` from ``node, blocks, id, sketch0.., allowed``: edges that join all members of a node whose sketches agree."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", *_SKETCH)
    key = ["node", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            edges = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(rows)], strict=True):
                if b - a > 1:
                    ids = rows[a:b, 4]
                    lowest = _alike(ids, rows[a:b, 3], np.ascontiguousarray(rows[a:b, 5:-1]), rows[a:b, -1])
                    edges.append(np.stack([lowest, ids])[:, lowest != ids])
            low, high = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

        held = np.zeros((0, 5 + len(_SKETCH)), np.int64)
        for batch in batches:
            if batch.num_rows:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
                # The last cell may go on in the next batch.
                last = len(held) - int((held[::-1, :3] == held[-1, :3]).all(1).cumprod().sum())
                if last:
                    yield cells(held[:last])
                    held = held[last:]
        if len(held):
            yield cells(held)

    return dealt.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(run, "a bigint, b bigint")


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: how many have the same ``key``."""
    sizes = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)))
    return attach(rows, sizes, key, name, rows.count())


def forest_nodes(reps: DataFrame, depth: int, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``node, id``: the nodes where each class is matched, as far as others are there; ``depth`` is that of ``prefixes``."""
    trees = reps.select("id", F.explode(F.arrays_zip("prefixes", "tails")).alias("t")).select("id", F.col("t.prefixes").alias("prefix"), F.col("t.tails").alias("tail"))
    shared = materialise(trees.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = materialise(attach(trees, shared, "prefix", "n", reps.count() * TREES, merge=True).where("n is not null"))
    miss = [math.log1p(-(threshold ** min(d, DEPTH))) for d in (depth, depth + 1, depth + 2)]
    if TREES * miss[1] > math.log(1 - recall):
        return rows.select(F.col("prefix").alias("node"), "id")  # no longer prefix finds enough
    few = rows.where(F.col("n") <= CROWD).select(F.col("prefix").alias("node"), "id")
    crowd = rows.where(F.col("n") > CROWD).select("id", F.xxhash64("prefix", F.shiftright("tail", 32)).alias("middle"), F.xxhash64("prefix", "tail", F.lit(2)).alias("whole"))
    crowd = materialise(_counted(materialise(crowd), "middle", "n1"))
    deep = (F.col("n1") > CROWD).cast("int")
    by_class = Window.partitionBy("id")
    # Log of the chance that no tree finds a pair at the threshold, over the trees of this class.
    chance = F.lit(TREES * miss[0]) + F.sum(F.when(deep == 1, miss[2] - miss[0]).otherwise(miss[1] - miss[0])).over(by_class)
    need = F.ceil((chance - math.log(1 - recall)) / max(miss[2] - miss[1], 1e-12))
    turn = F.row_number().over(by_class.orderBy(F.desc(deep), "n1", "middle"))
    judged = crowd.withColumn("deep", deep).withColumn("given", (F.col("n1") > CROWD) & (turn <= need))
    judged = materialise(judged)
    given = materialise(judged.where("given").groupBy("middle").agg(F.max("n1").alias("n1"), F.max("given").alias("short")))
    settled = attach(judged.select("id", "middle", "whole", "deep"), given, "middle", "n1", judged.count())
    node = F.when((F.col("deep") == 0) | F.coalesce("short", F.lit(False)), F.col("middle")).otherwise(F.col("whole"))
    return few.unionByName(settled.select(node.alias("node"), "id"))


def _candidates(reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: edges whose components hold every two classes that share a node and whose sketches agree."""
    nodes = materialise(nodes)
    least = materialise(nodes.groupBy("node").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = materialise(attach(nodes, least, "node", "n", nodes.count()).where("id != a").select("node", "n", "a", F.col("id").alias("b")))
    side = lambda k: reps.select(F.col("id").alias(k), *[F.col(s).alias(f"{k}_{s}") for s in _SKETCH])
    both = stars.select("a", "b").distinct().join(side("b"), "b").join(side("a"), "a")
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _WORDS), F.lit(0))
    # One bit differs with half the chance that the values do.
    judged = materialise(both.select("a", "b", (differ <= F.greatest("a_allowed", "b_allowed")).alias("agree")))
    # Where a link to the smallest is cut, the pairs among the others are no longer joined through it.
    cut = stars.where("n > 2").join(judged.where("not agree"), ["a", "b"], "left_semi")
    crowds = materialise(cut.groupBy("node").agg(F.max("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / PREFIX_BLOCK).cast("int")))
    members = attach(stars.select("node", F.col("b").alias("id")), crowds, "node", "n", stars.count()).where("blocks is not null")
    members = members.select("node", "blocks", "id").join(reps.select("id", *_SKETCH), "id")
    return judged.where("agree").select("a", "b").unionByName(_crowd_edges(members))


def _sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle number, size of each set): shingles told apart by their words, not by hashes."""
    lists = [split_words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    codes, distinct = pd.factorize(np.array(list(itertools.chain.from_iterable(lists)), dtype=object))
    doc = np.repeat(np.arange(len(lists)), sizes)
    base = len(distinct) + 2
    # Words past a document's end count as one more word, so shorter documents differ from longer ones.
    place = np.arange(len(codes))
    ends = np.cumsum(sizes)[doc] if len(doc) else np.zeros(0, np.int64)
    number = codes.astype(np.int64)
    for k in range(1, n):
        at = np.minimum(place + k, max(len(codes) - 1, 0))
        following = np.where(place + k < ends, codes[at], base - 1)
        _, number = np.unique(number * base + following, return_inverse=True)
    begins = place - (np.cumsum(sizes) - sizes)[doc] if len(doc) else place
    keep = (place + n <= ends) | ((begins == 0) & (sizes[doc] < n)) if len(doc) else np.zeros(0, bool)
    pair = np.unique(doc[keep] * max(len(codes), 1) + number[keep]) if keep.any() else np.zeros(0, np.int64)
    doc, number = np.divmod(pair, max(len(codes), 1))
    return doc, number, np.bincount(doc, minlength=len(texts))


def jaccard_matrix(texts: list[str], n: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(intersections, sizes): exact, of all pairs; with ``split``, of texts before it with those after."""
    doc, number, sizes = _sets(texts, n)
    count = np.bincount(number) if len(number) else np.zeros(0, np.int64)
    shared = count[number] > 1 if len(number) else np.zeros(0, bool)
    doc, number = doc[shared], np.unique(number[shared], return_inverse=True)[1]
    columns = int(number.max()) + 1 if len(number) else 0
    rows = len(texts)
    left, right = (slice(0, rows), slice(0, rows)) if split is None else (slice(0, split), slice(split, rows))
    total = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    width = max(1, DENSE // max(rows, 1))
    order = np.argsort(number, kind="stable")
    doc, number = doc[order], number[order]
    for at in range(0, columns, width):
        a, b = np.searchsorted(number, [at, at + width])
        x = np.zeros((rows, min(width, columns - at)), np.float32)
        x[doc[a:b], number[a:b] - at] = 1
        total += x[left] @ x[right].T
    return total, sizes


def _verify(ids: np.ndarray, copies: np.ndarray, block: np.ndarray, texts: list[str], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, smallest class that links within the cell lead to) of each class; a cell is one block, or the pairs between two."""
    order = np.argsort(block, kind="stable")
    split = int((block == block.min()).sum())
    split = None if split == len(ids) else split
    total, sizes = jaccard_matrix([texts[k] for k in order], n, split)
    ids, copies = ids[order], copies[order]
    left, right = (sizes, sizes) if split is None else (sizes[:split], sizes[split:])
    linked = total >= threshold * (left[:, None] + right[None, :] - total) - 1e-9
    linked &= total > 0
    lowest, most = ids.copy(), ids.max()
    if split is None:
        np.fill_diagonal(linked, False)
        links = linked @ copies
        lowest = _lowest(linked, ids)
    else:
        links = np.r_[linked @ copies[split:], linked.T @ copies[:split]]
        while True:
            before = lowest.copy()
            lowest[:split] = np.minimum(lowest[:split], np.where(linked, lowest[None, split:], most).min(1))
            lowest[split:] = np.minimum(lowest[split:], np.where(linked.T, lowest[None, :split], most).min(1))
            if (lowest == before).all():
                break
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    return links[back], lowest[back]


def _cells(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """``id, links, lowest`` of each class in each of its cells, from ``id, h, text`` of all rows and ``rep, h`` of the classes' own."""
    # Members grow with the input, so the plan is the same at any size: texts are dealt by id.
    own = members.withColumnRenamed("id", "number").withColumnRenamed("h", "own_h").hint("merge")
    texts = docs.select(F.col("id").alias("doc"), "h", "text").join(own, F.col("doc").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("own_h")))
    block = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")
    dealt = texts.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "number", "copies", "digest", "text")
    key = ["component", "i", "j"]
    sorted_cells = dealt.repartition(*key).sortWithinPartitions(*key, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(rows: list) -> pa.RecordBatch:
            ids, copies, block = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 3))
            links, lowest = _verify(ids, copies, block, [r[7] for r in rows], n, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(lowest)], names=["id", "links", "lowest"])

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield cell(held)
                    held = []
                # Rows that repeat the class's own row count once; if their texts only share its hash, the digest tells.
                if held and held[-1][4] == row[4]:
                    if held[-1][7] != row[7] and digests([row[7]], n)[0] == row[6]:
                        held[-1] = row
                    continue
                held.append(row)
        if held:
            yield cell(held)

    return sorted_cells.mapInArrow(run, "id bigint, links bigint, lowest bigint")


def ngram_jaccard_join(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, text_hash``: one row per document.

    Words are the lower-cased text split at white space. Two documents are linked if the
    Jaccard similarity of their sets of n-word shingles is ``threshold`` or more; a
    document of fewer than n words has all its words as its one shingle. ``class_id`` is
    the smallest id that links lead to, ``n_links`` the number of other documents that the
    document is linked with, ``n_copies`` how many have exactly its shingles (itself
    included). ``text_hash`` is the xxhash64 of the text, null as empty; it tells rows that
    repeat an id apart. Ids may have any type that has an order.

    Documents without words (null, empty, white space) are copies of each other. Rows with
    a null id take part like all others; ``class_id`` is null if only such rows are linked.
    Rows that repeat an id are a document each, with the same text or not. Texts of any
    length are compared whole. An empty table gives an empty result; extra columns are
    ignored, whatever their names.
    """
    depth = max(prefix_depth(threshold, recall=recall) - 1, 1)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), text.alias("text"))
    signed = materialise(sign(rows, n, depth, threshold))
    # Classes have numbers of their own, fixed by writing them: ids may be missing, repeated or no numbers.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"), F.col("bytes"))).alias("own")
    classes = signed.groupBy("digest").agg(least, F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("number"), "digest", F.col("own.id").alias("rep"), F.col("own.h").alias("h"), F.col("own.bytes").alias("bytes"), "copies"))
    first = signed.dropDuplicates(["digest"]).where(F.size("prefixes") > 0).select("digest", "prefixes", "tails", *_SKETCH)
    reps = materialise(first.join(classes.select("number", "digest"), "digest").select(F.col("number").alias("id"), "prefixes", "tails", *_SKETCH))
    groups = components(_candidates(reps, forest_nodes(reps, depth, threshold, recall)), "a", "b").select(F.col("node").alias("number"), "component")
    found = materialise(groups.join(classes, "number").select(F.col("number").alias("id"), "component", "digest", "rep", "h", "bytes", "copies"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1))).cast("int")
    sizes = materialise(found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")))
    members = materialise(attach(found, sizes, "component", "n", found.count()).drop("n", "bytes"))
    cells = materialise(_cells(rows, members, n, threshold))
    links = cells.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(cells.where("lowest != id"), "id", "lowest").select(F.col("node").alias("id"), F.col("component").alias("group"))
    # Of a group, the smallest id of a document.
    told = materialise(members.select("id", "rep").join(joined, "id"))
    names = materialise(told.groupBy("group").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n")))
    told = links.join(attach(told, names, "group", "n", told.count()).select("id", "class_id", F.lit(True).alias("linked")), "id", "left")
    result = classes.join(told.withColumnRenamed("id", "number"), "number", "left")
    own = F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("rep"))
    result = materialise(result.select("digest", "copies", own.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    shown = attach(signed.select("id", "digest", "h"), result, "digest", "copies", signed.count())
    return shown.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("copies").alias("n_copies"), F.col("h").alias("text_hash"))
