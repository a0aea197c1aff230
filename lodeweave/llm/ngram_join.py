"""N-gram Jaccard join by chosen paths.

Texts with equal sets of word shingles form one node. A node's set is embedded as ``SIZE`` min-hashes,
its tokens. In each run every node follows the tokens that a hash of (path, token) selects, each with
probability 1 / (threshold * SIZE): nodes on the same path share the tokens on it. A path with more
than ``SMALL`` nodes is split again, up to ``DEPTH`` tokens; smaller ones are compared by brute force.
Runs repeat until a pair at the threshold meets with the target recall.

Compared pairs pass a loose test on one byte of each min-hash and join nodes into candidate
components; inside these, links are verified on the exact shingle sets and counted, never listed.
Components and paths too large for one task are cut into blocks, those of components by size of the set, and every
pair of blocks that can hold a link is a task. A class of n texts of like size costs n * n comparisons in
n * n / BLOCK_NODES ** 2 tasks: as many links exist where they are near copies of one text, but not in chains.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import documents, map_arrow, stored

WORDS = 5
THRESHOLD = Fraction(4, 5)
SIZE = 128
RECALL = 0.999
DEPTH = 3
SMALL = 200
#: Nodes of a path in one task; nodes and shingles of a component's block.
PATH_BLOCK, BLOCK_NODES, BLOCK_SHINGLES = 8192, 256, 2_000_000
#: Candidate keys up to this many rows are broadcast to the scan of the texts.
BROADCAST_ROWS = 200_000

#: Bytes of a text hashed at a time, and of a shingle that is hashed by itself.
SEGMENT, LONG_SHINGLE = 1 << 20, 1 << 16

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of all words where there are fewer, none without words.

    Words stand between ASCII white space; which and how much does not matter.
    """
    data = b" ".join((text or "").encode().split())
    if not data:
        return np.zeros(0, _U)
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    n = max(1, len(starts) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    out, long = np.zeros(n, _U), np.flatnonzero(ends - starts > LONG_SHINGLE)
    at = 0
    while at < n:  # a hash depends on its bytes only, so a long text is done in segments
        first = int(starts[at])
        stop = int(np.searchsorted(ends, first + SEGMENT, "right"))
        if stop > at:
            part = raw[first : int(ends[stop - 1])]
            power, inverse = _power_tables(len(part))
            prefix = np.zeros(len(part) + 1, _U)
            np.cumsum((part.astype(_U) + _U(1)) * power, out=prefix[1:])
            a = starts[at:stop] - first
            out[at:stop] = (prefix[ends[at:stop] - first] - prefix[a]) * inverse[a]
        at = max(stop, at + 1)
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return np.unique(mixed(out))


_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(0, 1 << 32, SIZE, dtype=np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)[None, :]


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> _U(32)).astype(np.uint32)[:, None]
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024] * _A + _B).min(axis=0), out=out)
    return out


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold shares a path of ``depth`` tokens with probability ``recall``.

    The paths that a pair shares are a branching process with one child on average: it lives through
    one level more with probability 1 - exp(-p).
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def steps(tokens: np.ndarray, paths: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``tokens`` on a path: the row numbers and ids of the paths one token longer."""
    z = mixed(tokens ^ mixed(paths)[:, None])
    rows, _ = hit = np.nonzero(z < _U(int((1 << 64) / (float(threshold) * SIZE))))
    return rows, mixed(z[hit] + _U(0x632BE59BD9B4E019))


def _tokens(signatures: Iterable[bytes]) -> np.ndarray:
    sig = np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, SIZE).astype(_U)
    return mixed(sig | (np.arange(SIZE, dtype=_U) << _U(32))[None, :])


def _by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows with equal first column from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _labels(near: np.ndarray) -> np.ndarray:
    """The least index of each component of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    for i in range(n):
        if label[i] != i:
            continue
        wave = np.array([i])
        while len(wave):
            reached = near[wave].any(axis=0)
            wave = np.flatnonzero(reached & (label > i))
            label[wave] = i
    return label


def _near_sketches(sketch: np.ndarray, sizes: np.ndarray, least: int, threshold: Fraction) -> np.ndarray:
    """Index of a linked node, or of itself, for each row: connected rows share the last one, as ``_labels``."""
    n = len(sketch)
    num, den = threshold.numerator, threshold.denominator

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        equal = (sketch[i][:, None, :] == sketch[j][None, :, :]).sum(axis=2)
        a, b = sizes[i][:, None], sizes[j][None, :]
        return (equal >= least) & (num * np.maximum(a, b) <= den * np.minimum(a, b))

    everyone = np.arange(n)
    if n <= 64:
        return _labels(near(everyone, everyone))
    label = everyone.copy()  # of clusters around leaders; then whole clusters are compared with each other
    free = np.ones(n, bool)
    while free.any():
        leader = np.flatnonzero(free)[:1]
        close = near(leader, everyone)[0] & free
        close[leader] = True
        label[close] = leader[0]
        free &= ~close
    for i in range(0, n, 16):
        rows = everyone[i : i + 16]
        others = everyone[np.isin(label, label[rows], invert=True) | (len(np.unique(label[rows])) > 1)]
        if len(others):
            for a, b in zip(*np.nonzero(near(rows, others)), strict=True):
                x, y = label[rows[a]], label[others[b]]
                if x != y:
                    label[label == max(x, y)] = min(x, y)
    return label


def verified_links(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Symmetric boolean matrix of the pairs whose Jaccard similarity is at least ``threshold``."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    inter = np.zeros((n, n), np.int64)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        width = 2048
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], column[a:b] - k * width] = 1
            inter += (m @ m.T).astype(np.int64)
    num, den = threshold.numerator, threshold.denominator
    linked = inter * (num + den) >= num * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    return linked


def components(edges: DataFrame) -> DataFrame:
    """For edges (v, u) with u < v: one row per node v but the least of its component, with u that least node.

    Small-star and pointer-jump rounds on written tables; only counts reach the driver.
    """
    edges = edges.select("v", "u").distinct()
    while True:
        least = edges.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
        star = least.select(F.explode(F.when(F.col("u") == F.col("m"), F.array(pair("v", "m"))).otherwise(F.array(pair("v", "m"), pair("u", "m")))).alias("e")).select("e.*").distinct()
        star = stored(star, "star")
        parent = star.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("p"))
        jumped = star.join(parent, star["u"] == parent["x"], "left").select("v", F.coalesce("p", "u").alias("u"), F.col("p").isNotNull().alias("moved"))
        jumped = stored(jumped, "jumped")
        seen = jumped.agg(F.count_if("moved").alias("moved"), F.count("*").alias("rows"), F.countDistinct("v").alias("nodes")).first()
        if not seen["moved"] and seen["rows"] == seen["nodes"]:
            return jumped.select("v", "u")
        edges = jumped.select("v", "u").distinct()


def in_blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Deal the rows of a ``key`` into blocks by ``v`` and repeat each for every pair with another block.

    Adds ``block`` and ``task``; one block gives one task and one copy.
    """
    rows = rows.withColumn("__n", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("v"), F.col("__n")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.withColumn("task", F.xxhash64(F.col(key), F.least("block", "__other"), F.greatest("block", "__other"))).drop("__n", "__other")


def size_blocks(members: DataFrame, threshold: Fraction, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``block`` and ``blocks`` to the nodes (c, v, n) of components: where each stands, and the blocks that it must meet, its own included.

    A component of one block is one task. Larger ones are cut into classes of size so that linked sets are in one class or in
    neighbouring ones, and classes into blocks of BLOCK_NODES nodes: blocks of classes further apart never meet.
    """
    base = math.log(1.01 / float(threshold))
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / base).cast("int"))
    need = lambda: F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    bands = members.groupBy("c", "band").agg(need().alias("own"), F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    whole = bands.groupBy("c").agg(F.ceil(F.greatest(F.sum("nodes") / BLOCK_NODES, F.sum("shingles") / BLOCK_SHINGLES)).alias("whole"))
    bands = bands.join(whole, "c").where("whole > 1").select("c", "band", "own")
    near = bands.select("c", (F.col("band") - 1).alias("band"), F.col("own").alias("above")).unionByName(bands.select("c", (F.col("band") + 1).alias("band"), F.col("own").alias("below")), allowMissingColumns=True)
    near = near.groupBy("c", "band").agg(F.max("above").alias("above"), F.max("below").alias("below"))
    bands = stored(bands.join(near, ["c", "band"], "left").withColumnRenamed("c", "__c").withColumnRenamed("band", "__band"), "bands")
    bands = F.broadcast(bands) if bands.count() <= broadcast_rows else bands  # classes of large components only
    out = members.join(bands, (F.col("c") == F.col("__c")) & (F.col("band") == F.col("__band")), "left")
    # a block's number: its class and its place there; one block: no class
    number = lambda band, i: (F.col("band") + band).cast("long") * (1 << 32) + i
    mine = F.when(F.col("own").isNull(), F.lit(0).cast("long")).otherwise(number(0, F.pmod(F.xxhash64("v"), F.col("own"))))
    row = lambda band, n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: number(band, i))).otherwise(F.array().cast("array<bigint>"))
    met = F.when(F.col("own").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(row(-1, "below"), row(0, "own"), row(1, "above")))
    return out.withColumn("block", mine).withColumn("blocks", met).drop("band", "own", "above", "below", "__c", "__band")


def _sketch_edges(threshold: Fraction):
    j = float(threshold)
    least = math.floor(SIZE * j - 4.5 * math.sqrt(SIZE * j * (1 - j)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v_out, u_out = [], []
        for group in _by_key(batches):
            if len(group) > 1:
                v = group.column("v").to_numpy()
                if len(v := v[keep := np.sort(np.unique(v, return_index=True)[1])]) < 2:
                    continue
                sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)[keep]
                label = _near_sketches(sketch, group.column("n").to_numpy()[keep], least, threshold)
                root = np.full(len(v), np.iinfo(np.int64).max)
                np.minimum.at(root, label, v)
                root = root[label]
                v_out.append(v[v != root])
                u_out.append(root[v != root])
                if len(v_out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v_out)), pa.array(np.concatenate(u_out))], names=["v", "u"])
                    v_out, u_out = [], []
        if v_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v_out)), pa.array(np.concatenate(u_out))], names=["v", "u"])

    return run


def _verify(threshold: Fraction, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["v", "texts", "docs", "u"])

        for group in _by_key(batches):
            v, keep = np.unique(group.column("v").to_numpy(), return_index=True)
            if len(v) < 2:
                continue
            group = group.take(pa.array(keep))
            block, weight = group.column("block").to_numpy(), group.column("weight").to_numpy()
            linked = verified_links([shingles(t, words) for t in group.column("text").to_pylist()], threshold)
            if block.min() != block.max():  # links inside a block are counted in its own task
                linked &= block[:, None] != block[None, :]
            texts, docs, label = linked.sum(axis=1), linked @ weight, _labels(linked)
            out += [(int(v[i]), int(texts[i]), int(docs[i]), int(v[label[i]])) for i in np.flatnonzero(texts)]
            if len(out) > 20_000:
                yield made()
                out.clear()
        yield made()

    return run


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL, broadcast_rows: int = BROADCAST_ROWS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: ``id_col``, ``text_hash``, ``class_id``, ``n_links``, ``n_texts``, ``copies``, ``kept``.

    ``class_id``: smallest id of the row's connected component of links; ``n_links``: other rows linked
    to it directly, copies included; ``n_texts``: other shingle sets linked; ``copies``: rows with an
    equal set. One row of each class is kept: that with the smallest id (nulls last), of rows with equal
    id and text any one. Rows without a word (null and empty texts) link to none and are kept, each a class of its own
    (class_id: own id). Rows of fewer than ``words`` words have one shingle. Very long texts are shingled whole. An empty table gives an
    empty result. Columns of ``carry`` come along, for a row id; others are ignored, whatever their names.
    ``text_hash``: xxhash64 of the text, to find the row again where ids repeat.
    """
    t = Fraction(threshold)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, words) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *batch.columns[3:], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array([min_hashes(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["id", "text_hash", *carried, "n", "digest", "signature"],
            )

    carried = [f"__carry{i}" for i in range(len(carry))]
    part = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"), *(F.col(c).alias(h) for c, h in zip(carry, carried, strict=True)))
    kinds = {f.name: f.dataType.simpleString() for f in part.schema}
    rows = stored(map_arrow(part, sign, f"id {kinds['id']}, text_hash bigint, {''.join(f'{h} {kinds[h]}, ' for h in carried)}n bigint, digest string, signature binary"), "signatures")

    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("hash")))
    nodes = rows.where("n > 0").groupBy("digest", "n").agg(first.alias("first"), F.count("*").alias("weight"), F.first("signature").alias("signature"))
    nodes = stored(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")

    def low_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, SIZE).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in low], pa.binary())], names=["v", "n", "sketch"])

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, runs_for(recall, depth) + 1, dtype=_U))
        for b in batches:
            tokens, v = _tokens(b.column(1).to_pylist()), b.column(0).to_numpy()
            for root in roots:
                at, path = steps(tokens, np.full(len(v), root), t)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(v[at])], names=["path", "v"])

    def go_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy()
            at, path = steps(_tokens(b.column(2).to_pylist()), b.column(1).to_numpy().view(_U), t)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(v[at])], names=["path", "v"])

    paths = map_arrow(nodes.select("v", "signature"), begin, "path bigint, v bigint")
    ends: DataFrame | None = None
    for level in range(1, depth + 1):
        paths = stored(paths, f"paths{level}")
        held = stored(paths.groupBy("path").count().where("count > 1"), f"counts{level}")  # a table: the join can then split a hot path
        paths = stored(paths.join(held, "path"), f"held{level}")
        done = paths.where(F.col("count") <= small) if level < depth else paths
        ends = done if ends is None else ends.unionByName(done)
        if level < depth:
            large = paths.where(F.col("count") > small)
            paths = map_arrow(large.join(nodes.select("v", "signature"), "v").select("v", "path", "signature"), go_on, "path bigint, v bigint")
    ends = in_blocks(ends, "path", F.ceil(F.col("count") / PATH_BLOCK)).select("task", "v")
    sketches = map_arrow(nodes.select("v", "n", "signature"), low_bytes, "v bigint, n bigint, sketch binary")
    met = ends.join(sketches, "v").select("task", "v", "n", "sketch").repartition("task").sortWithinPartitions("task")
    tree = components(map_arrow(met, _sketch_edges(t), "v bigint, u bigint"))

    members = tree.select("v", F.col("u").alias("c")).unionByName(tree.select(F.col("u").alias("v"), F.col("u").alias("c")).distinct())
    members = members.join(nodes.select("v", "n", "weight", "first.id", "first.hash"), "v")
    keys = stored(size_blocks(members, t, broadcast_rows).select("c", "v", "weight", "block", "blocks", "id", F.col("hash").alias("text_hash")), "candidates")
    found = part.select(F.col("id").alias("own"), F.col("text_hash").alias("own_hash"), "text")
    side = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    found = found.join(side, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")))
    each = found.select("c", "v", "weight", "block", F.explode("blocks").alias("other"), "text")
    tasks = each.select(F.xxhash64("c", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "v", "block", "weight", "text")
    links = map_arrow(tasks.repartition("task").sortWithinPartitions("task"), _verify(t, words), "v bigint, texts bigint, docs bigint, u bigint")
    links = stored(links, "links")
    degrees = links.groupBy("v").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    tree = components(links.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")))

    known = nodes.select("digest", "n", "v", "weight", "first").join(degrees, "v", "left").join(tree, "v", "left").withColumn("c", F.coalesce("u", "v"))
    firsts = known.groupBy("c").agg(F.min("first").alias("class_first"))
    known = stored(known.join(firsts, "c").select("digest", "n", "weight", "texts", "docs", "class_first"), "classes")
    out = rows.select("id", "text_hash", *carried, "n", "digest").join(known, ["digest", "n"], "left")
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("hash"))
    turn = Window.partitionBy("id", "text_hash", "digest").orderBy(F.lit(1))
    kept = (F.col("n") == 0) | (F.col("class_first").eqNullSafe(own) & (F.row_number().over(turn) == 1))
    return out.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.when(F.col("n") > 0, F.col("class_first.id")).otherwise(F.col("id")).alias("class_id"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("weight", F.lit(1)).cast("long").alias("copies"),
        kept.alias("kept"),
        *(F.col(h).alias(c) for c, h in zip(carry, carried, strict=True)),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
), k AS (
  SELECT doc_id, len(sh) AS n, sh, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(sh), '|'))) AS v,
         count(*) OVER (PARTITION BY md5(array_to_string(list_sort(sh), '|'))) AS copies FROM s WHERE len(sh) > 0
), x AS (
  SELECT v, n, unnest(sh) AS g FROM k WHERE doc_id = v
), p AS (
  SELECT a.v AS a, b.v AS b FROM x a JOIN x b ON a.g = b.g AND a.v < b.v GROUP BY a.v, b.v, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), c AS (
  SELECT v, v AS c FROM k WHERE doc_id = v UNION SELECT l.b, c.c FROM c JOIN l ON l.a = c.v WHERE c.c < l.b
), m AS (
  SELECT v, min(c) AS class_id FROM c GROUP BY v
), g AS (
  SELECT l.a AS v, count(*) AS texts, sum(k.copies)::BIGINT AS docs FROM l JOIN k ON k.doc_id = l.b GROUP BY l.a
)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(g.docs, 0) + coalesce(k.copies, 1) - 1 AS n_links,
       coalesce(g.texts, 0) AS n_texts, coalesce(k.copies, 1) AS copies, coalesce(m.class_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN m ON m.v = k.v LEFT JOIN g ON g.v = k.v
"""
