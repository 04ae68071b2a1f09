"""Near-duplicate classes by DartMinHash signatures and banded candidate search.

A text is the set of its five-word shingles, or with ``weights='count'`` the multiset. Darts are thrown, by hash, into the
plane (weight, rank) of each shingle: the plane is cut into regions that double in both
directions, each region into cells of area one, and each cell holds a Poisson(1) number
of darts. A dart hits a text if it lies below the shingle's weight. Each dart belongs to
one of ``K`` coordinates; the hit of lowest rank is the coordinate's value. The number of
darts depends on ``K`` and not on the length of the text: the rank bound is chosen so that
about K ln K + 2K darts hit, and doubled for texts with an empty coordinate. Two
signatures agree in a coordinate with the probability of the weighted Jaccard similarity.

Candidates share a band of the signature. In each bucket the smallest member is compared
with the others, which joins most of a group with one comparison for each member. Members
of buckets that still hold several classes are then compared across classes in cells of
bounded size: pairs whose signatures agree often enough, each in the first band they share,
best first, until the two classes are one. So every candidate pair between two classes is
tried, and nothing is emitted but links that join classes. Every link passed an exact
comparison of the shingles. Classes are the connected components.

Equal texts are one node from the start, so a group of copies costs one signature, one
node and no pairs.

Edge cases: a null text is empty; texts without a word are alike only if equal; a text of
fewer than five words is one shingle; rows with null or repeated ids are members of their
text's class; the class id is the smallest doc_id in the class (null if there is none);
an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.components import components
from corpusloom.llm.registry import query, table
from corpusloom.llm.textgrams import (
    ROUND, U, counted, mix, pair, ranges, shingles, slices, text_bytes)
from corpusloom.storage import stage

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Candidates need this share of equal coordinates: four standard deviations below 0.8.
ESTIMATE = 0.66
#: Members of a bucket on each side of a comparison cell.
CELL = 512

_TEXT_CHUNK = 1 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_NONE = np.iinfo(np.uint64).max


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0 ** -53


def throw_darts(value: np.ndarray, weight: np.ndarray, bound: np.ndarray):
    """Darts that hit: (element, rank, dart) for elements with a weight and a rank bound.

    A dart depends on its element's ``value`` and its cell only.
    """
    element, ranks, darts = [], [], []
    if len(value) == 0:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, U)
    for v in range(int(math.log2(1 + weight.max())) + 1):
        for r in range(int(math.log2(1 + bound.max())) + 1):
            w0, r0, wide, high = 2.0 ** v - 1, 2.0 ** r - 1, 2.0 ** (v - r), 2.0 ** (r - v)
            e = np.flatnonzero((weight > w0) & (bound > r0))
            if len(e) == 0:
                continue
            # Cells below the element's weight and rank bound.
            n_w = np.minimum(np.ceil((weight[e] - w0) / wide), 2 ** r).astype(np.int64)
            n_r = np.minimum(np.ceil((bound[e] - r0) / high), 2 ** v).astype(np.int64)
            own = np.repeat(e, n_w * n_r)
            cell = ranges(n_w * n_r)
            per = np.repeat(n_r, n_w * n_r)
            i, j = cell // per, cell % per
            name = U((v << 8) | r) + (i.astype(U) << U(16)) + (j.astype(U) << U(40))
            seed = pair(value[own], mix(name + ROUND))
            count = np.searchsorted(_POISSON, _unit(seed), "right")
            hit = np.repeat(np.arange(len(own)), count)
            dart = mix(seed[hit] + (ranges(count).astype(U) + U(1)) * ROUND)
            second = mix(dart + ROUND)
            at, rank = w0 + (i[hit] + _unit(dart)) * wide, r0 + (j[hit] + _unit(second)) * high
            good = (at < weight[own[hit]]) & (rank < bound[own[hit]])
            element.append(own[hit[good]])
            ranks.append(rank[good])
            darts.append(mix(second[good] + ROUND))
    return np.concatenate(element), np.concatenate(ranks), np.concatenate(darts)


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int,
               size: int) -> np.ndarray:
    """A matrix of texts x size: rank and dart of the earliest hit, packed; no shingle, no value."""
    out = np.full(texts * size, _NONE, U)
    total = np.bincount(text, weights=weight, minlength=texts)
    aim = size * math.log(size) + 2 * size
    bound = aim / np.maximum(total, 1e-300)
    todo = total > 0
    weight = weight.astype(np.float64)
    while todo.any():
        mine = todo[text]
        e, rank, dart = throw_darts(value[mine], weight[mine], bound[text[mine]])
        place = text[mine][e] * size + (dart % U(size)).astype(np.int64)
        packed = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart >> U(32))
        np.minimum.at(out, place, packed)
        todo = todo & (out.reshape(texts, size) == _NONE).any(1)
        bound = bound * 2
    return out.reshape(texts, size)


_SIGNED = T.StructType([
    T.StructField("_h", T.StringType()), T.StructField("sig", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType()))])


def _sign(words: int, bands: int, rows: int, weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, _TEXT_CHUNK):
                at = offsets[lo:hi + 1]
                text, value, weight = counted(*shingles(data[at[0]:at[-1]], at - at[0], words))
                if weights == "set":
                    weight = np.ones(len(weight))
                made = signatures(text, value, weight, hi - lo, bands * rows)
                some = (made != _NONE).all(1)
                low = (made & U(255)).astype(np.uint8)
                keys = np.broadcast_to(np.arange(bands, dtype=U), (hi - lo, bands)).copy()
                for k in range(rows):
                    keys = pair(keys, made.reshape(hi - lo, bands, rows)[:, :, k])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_h").slice(lo, hi - lo),
                    pa.array([low[i].tobytes() if ok else None for i, ok in enumerate(some)],
                             pa.binary()),
                    pa.array([k if ok else None for k, ok in zip(keys.view(np.int64), some, strict=True)],
                             pa.list_(pa.int64()))], names=_SIGNED.names)
    return run


_SETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("elements", T.BinaryType())])


def _sets(words: int, weights: str):
    """The shingles of each text as sorted 32-bit numbers; the k-th copy of one is an element."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, _TEXT_CHUNK):
                at = offsets[lo:hi + 1]
                text, value, count = counted(*shingles(data[at[0]:at[-1]], at - at[0], words))
                if weights == "count":
                    text, value = np.repeat(text, count), pair(np.repeat(value, count), ranges(count).astype(U))
                small = (value >> U(32)).astype(np.uint32)
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").slice(lo, hi - lo),
                    pa.array([np.unique(small[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)],
                             pa.binary())], names=_SETS.names)
    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct numbers."""
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(a) + len(b) - shared)


def _numbers(column: pa.Array | pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(x, y) >= similarity - 1e-12 for x, y in zip(
                _numbers(batch.column("_ea"), np.uint32), _numbers(batch.column("_eb"), np.uint32),
                strict=True)]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])
    return run


def _compare_cell(estimate: float, similarity: float):
    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        label = group.column("label").to_numpy()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        band = group.column("band")[0].as_py()
        sig = np.stack(_numbers(group.column("sig"), np.uint8))
        elements = _numbers(group.column("elements"), np.uint32)
        size = np.array([len(e) for e in elements])
        keys = np.stack([k.values.to_numpy() for k in group.column("bands").combine_chunks()])[:, :band]
        _, of = np.unique(label, return_inverse=True)
        parent = list(range(int(of.max()) + 1))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        gives = np.flatnonzero(~asks)
        for q in np.flatnonzero(asks).tolist():
            others = gives[of[gives] != of[q]]
            share = (sig[others] == sig[q]).mean(1)
            fits = np.minimum(size[others], size[q]) >= similarity * np.maximum(size[others], size[q]) - 1e-9
            new = ~(keys[others] == keys[q]).any(1)  # not together in an earlier band
            at = np.flatnonzero((share >= estimate) & fits & new)
            for t in others[at[np.argsort(-share[at], kind="stable")]].tolist():
                x, y = top(int(of[q])), top(int(of[t]))
                if x != y and jaccard(elements[q], elements[t]) >= similarity - 1e-12:
                    parent[x] = y
                    found.append((node[q], node[t]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.max(1), "b": pairs.min(1)})
    return run


def _across_classes(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame,
                    estimate: float, similarity: float, cell: int) -> DataFrame:
    """Links between classes that share a bucket.

    Members outside the bucket's largest class ask; all members answer, in cells of at most
    ``cell`` asking and ``cell`` answering members (about; they are dealt by hash).
    """
    known = buckets.join(labels, "node", "left").select(
        "band", "key", "node", F.coalesce("label", "node").alias("label"))
    sizes = known.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = stage(sizes.groupBy("band", "key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("classes")).where("classes > 1").select(
        "band", "key", F.col("top.label").alias("largest"),
        F.ceil((F.col("n") - F.col("top.n")) / cell).cast("int").alias("n_asks"),
        F.ceil(F.col("n") / cell).cast("int").alias("n_gives")))
    members = stage(known.join(mixed, ["band", "key"]))
    place = F.xxhash64("node")
    gives = members.select(
        "band", "key", "node", "label", F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("n_asks") - 1)).alias("x"),
        F.pmod(place, "n_gives").cast("int").alias("y"))
    asks = members.where("label <> largest").select(
        "band", "key", "node", "label", F.lit(True).alias("asks"),
        F.pmod(place, "n_asks").cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("n_gives") - 1)).alias("y"))
    content = nodes.select("node", "sig", "bands").join(sets, "node")
    return gives.unionByName(asks).join(content, "node").groupBy("band", "key", "x", "y").applyInArrow(
        _compare_cell(estimate, similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS, estimate: float = ESTIMATE, cell: int = CELL,
                    weights: str = "set") -> DataFrame:
    """``doc_id``, text_md5, class_id and first (the text that stands for its class).

    One row for each row of ``docs``.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    if weights not in ("set", "count"):
        raise ValueError("weights is 'set' or 'count'")
    raw = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("_d"), F.md5(raw.cast("binary")).alias("_h"), raw.alias("_x"))
    signed = keyed.select("_h", "_x").mapInArrow(_sign(words, bands, rows, weights), _SIGNED)
    nodes = stage(signed.dropDuplicates(["_h"]).select(
        F.monotonically_increasing_id().alias("node"), "_h", "sig", "bands"))

    # Buckets with two texts or more, and the comparison with their smallest member.
    banded = nodes.where("sig IS NOT NULL").select("node", F.posexplode("bands").alias("band", "key"))
    full = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("b")).where("n > 1")
    buckets = stage(banded.join(full, ["band", "key"]).select("band", "key", "node", "b"))
    starred = buckets.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    sig = nodes.select(F.col("node").alias("_n"), F.col("sig").alias("_s"))
    close = starred.join(sig, F.col("a") == F.col("_n")).drop("_n").withColumnRenamed("_s", "_sa").join(
        sig, F.col("b") == F.col("_n")).mapInArrow(_estimated(estimate), "a long, b long")
    close = stage(close)

    # Shingles of the texts that share a bucket.
    involved = buckets.select("node").distinct().join(nodes.select("node", "_h"), "node")
    sets = stage(keyed.select("_h", "_x").join(involved, "_h").dropDuplicates(["node"]).select(
        "node", "_x").mapInArrow(_sets(words, weights), _SETS))
    one, two = (sets.select(F.col("node").alias(n), F.col("elements").alias(e))
                for n, e in (("a", "_ea"), ("b", "_eb")))
    links = stage(close.join(one, "a").join(two, "b").select("a", "b", "_ea", "_eb").mapInArrow(
        _verify(similarity), "a long, b long"))
    labels = stage(components(links))
    more = stage(_across_classes(buckets, nodes, sets, labels, estimate, similarity, cell))
    labels = stage(components(links.unionByName(more)))

    named = nodes.join(labels, "node", "left").select("_h", F.coalesce("label", "node").alias("_c"))
    placed = keyed.select("_d", "_h").join(named, "_h")
    classes = placed.groupBy("_c").agg(F.min("_d").alias("class_id"),
                                       F.min_by("_h", F.struct(F.col("_d").isNull(), "_d", "_h")).alias("_first"))
    return placed.join(classes, "_c").select(
        F.col("_d").alias(doc_id), F.col("_h").alias("text_md5"), "class_id",
        (F.col("_h") == F.col("_first")).alias("first"))


def _estimated(estimate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.stack([np.frombuffer(s, np.uint8) for s in batch.column(c).to_pylist()])
                    for c in ("_sa", "_s"))
            keep = pa.array((a == b).mean(1) >= estimate)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])
    return run


@query("op3_dart_minhash")
def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
