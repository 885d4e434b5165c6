"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of the 64 is given a nonzero vector of ``radius + 1`` bits. For each nonzero
vector v there is one table, and its mask keeps the positions whose vector has an odd product
with v. The positions where two fingerprints differ are ``radius`` at most, so their vectors
leave some v orthogonal to all of them: in that table none of the differing positions is kept
and the pair collides. No pair within the radius is missed, whatever the data.

Documents are first reduced to their distinct fingerprints. A bucket of a table is compared in
blocks: one of more than ``BLOCK`` fingerprints is dealt by hash to several blocks, and every two
blocks meet in one group of bounded size. A task emits no pairs but a forest that connects what
it found linked, a row per fingerprint at most. The forests are then joined into components by
iterated minimum labels with pointer jumping, each round a written table.

The pipeline's stage links texts whose sets of five-word shingles have a similarity of 0.8 or
more. There 64 bits of SimHash differ by 9.7 on average and the masks of a radius that holds such
pairs would be over 65,000, so the stage applies the same covering masks, of the same radius 3, to
a sketch of ``COORDINATES`` minimum hashes: equal texts have all in common, a pair of similarity
0.8 differs in 1.6 of the eight, and any that differ in three at most collide in a table. Its 15
masks are the words of the extended Hamming code, so a bucket agrees in four of the eight at
least. Those that collide are linked if their minima in ``BINS`` bins agree in ``SIMILAR`` of the
bins that either fills: all shingles of a short text, an estimate with a standard error of 0.025
for long ones.

A null text has no words and the fingerprint zero, linked like any other; so has an empty one.
Null ids take part and are never the smallest id; a component of null ids only has a null id.
Repeated rows and repeated ids are each returned by the query; the stage keeps one of rows alike.
A text of any length is one row of a fixed size once it is hashed. An empty table gives an empty
table. Extra input columns are not carried by the query; the stage carries them whatever their
names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import free_names, table, text_pieces
from tidelog.session import drop, save

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket that are compared with one another in one piece.
BLOCK = 2048
#: Of the stage: words of a shingle, minimum hashes under the masks, bins of a sketch, least share of equal bins, sketches compared in one piece.
WIDE, COORDINATES, BINS, SIMILAR, SKETCHES = 5, 8, 256, 0.8, 2048


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The mask of each of the 2 ** (radius + 1) - 1 tables."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


MASKS = covering_masks()
#: Coordinate i has the vector 8 + i, so the masks keep four coordinates or all.
SKETCH_MASKS = [[i for i in range(COORDINATES) if ((8 + i) & v).bit_count() % 2] for v in range(1, 16)]
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of its hashes; zero without hashes."""
    out = np.zeros(len(sizes), np.uint64)
    have = np.flatnonzero(sizes)
    if not len(have):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[have])[:-1]])
    # runs of 255 hashes at most, so that eight counters of a byte fit one word
    runs = (sizes[have] + 254) // 255
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    step = np.arange(runs.sum()) - np.repeat(first, runs)
    cuts = np.repeat(starts, runs) + 255 * step
    half = sizes[have]
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[have] |= (2 * counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + b)
    return out


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; fewer words are one run."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in text_pieces(batches):
        parts = [np.array(shingle_hashes(t), np.uint64) for t in texts]
        prints = majority_bits(np.concatenate(parts), np.array([len(x) for x in parts], np.int64))
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "fp": prints.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""
    ids = docs.select("doc_id", F.col("text").cast("string"))
    return ids.mapInArrow(_fingerprints, f"doc_id {dict(ids.dtypes)['doc_id']}, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the same components as the edges (a, b); root is the least node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, label[u], low)
        np.minimum.at(now, label[v], low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links(near, reduce_at: int = 2_000_000):
    """A function from rows sorted by group to the links within each group, as a forest.

    ``near`` says which of two equally long tables of rows are linked, row by row.
    """

    def found(group: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node = rows.column("node").to_numpy()
        payload = near.payload(rows)
        a, b = [], []
        change = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
        start = np.concatenate([[0], change])
        end = np.repeat(np.concatenate([change, [len(node)]]), np.diff(np.concatenate([start, [len(node)]])))
        at = np.arange(len(node))
        step = 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            linked = near.linked(payload, at, at + step)
            a.append(node[at[linked]]), b.append(node[at[linked] + step])
            if sum(map(len, a)) > reduce_at:
                a, b = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))
            step += 1
        if not a:
            return
        node, root = forest(np.concatenate(a), np.concatenate(b))
        if len(node):
            yield pa.RecordBatch.from_pydict({"node": node, "root": root})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in frames:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            group = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("mask", "bucket", "low", "high")], axis=1)
            if not len(group):
                continue
            last = np.flatnonzero(np.any(group != group[-1], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from found(group[:cut], rows.slice(0, cut))
            held, rest = rows.slice(cut), group[cut:]
        if held is not None and held.num_rows:
            yield from found(rest, held)

    return run


class WithinRadius:
    """Fingerprints that differ in ``RADIUS`` bits at most."""

    columns: tuple[str, ...] = ()

    @staticmethod
    def payload(rows: pa.Table) -> np.ndarray:
        return rows.column("node").to_numpy().view(np.uint64)

    @staticmethod
    def linked(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS


class SimilarSketches:
    """Sketches whose bins agree in ``SIMILAR`` of those that either fills."""

    columns = ("bins",)

    @staticmethod
    def payload(rows: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)

    @staticmethod
    def linked(bins: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), 4096):
            x, y = bins[i[a : a + 4096]], bins[j[a : a + 4096]]
            filled = (x | y) > 0
            out[a : a + 4096] = ((x == y) & filled).sum(axis=1) >= SIMILAR * filled.sum(axis=1)
        return out


def bucket_links(keyed: DataFrame, near, block: int, payload: DataFrame | None = None) -> DataFrame:
    """(node, root): edges whose components are those of all linked pairs of a bucket.

    ``keyed`` has (node, mask, bucket); ``payload`` the columns that ``near`` compares, by node.
    """
    sizes = keyed.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # a block meets each other block and itself, in the group that both name (low, high)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = keyed.join(sizes, ["mask", "bucket"])
    if payload is not None:
        dealt = dealt.join(payload, "node")
    dealt = (
        dealt.withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("mask", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", *near.columns)
    )
    group = ["mask", "bucket", "low", "high"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(near), "node long, root long")


def covering_links(prints: DataFrame) -> DataFrame:
    """(node, root): edges whose components are those of all pairs of ``fp`` within the radius.

    ``prints`` has one row per distinct ``fp``.
    """
    tables = F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long").alias("keep")) for i, m in enumerate(MASKS)))
    keyed = prints.select("fp", F.explode(tables).alias("t")).select(F.col("fp").alias("node"), "t.mask", F.col("fp").bitwiseAND(F.col("t.keep")).alias("bucket"))
    return bucket_links(keyed, WithinRadius, BLOCK)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) and the least node of its component.

    Each round sends every label over the edges and then to the label's own label; a round is
    one written table. It ends when nothing changed, after about the logarithm of the longest path.
    """
    both = save(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct(), "edges")
    labels = save(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("root"))
        # hooking: the least label seen by any member of a root's tree becomes that root's label too
        hook = near.join(labels.select("node", F.col("root").alias("old")), "node").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("hook"))
        met = labels.join(near.select("node", F.col("root").alias("seen")), "node", "left").join(hook, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "seen", "hook").alias("root"))
        met = save(met, "labels")
        jump = met.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = save(met.join(jump, "root", "left").select("node", "old", F.least("root", "above").alias("root")), "labels")
        drop(labels), drop(met)
        labels = now
        if not now.where(F.col("old") != F.col("root")).limit(1).count():
            break
    drop(both)
    return labels.select("node", "root")


def named_components(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id, keep) of each row of ``distinct`` (node, least), by the edges ``links``.

    ``keep`` is the node of the component's smallest id, of several the least.
    """
    links = save(links, "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    member = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    named = member.groupBy("root").agg(first.alias("f")).select("root", F.col("f.least").alias("component_id"), F.col("f.node").alias("keep"))
    out = save(member.join(named, "root").select("node", "component_id", "keep"), "components")
    drop(links, roots)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = save(fingerprints(docs), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    names = named_components(distinct.withColumnRenamed("fp", "node"), covering_links(distinct))
    drop(distinct)
    return prints.join(names.withColumnRenamed("node", "fp"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_RANDOM = np.random.default_rng(23).integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def wide_shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct runs of ``WIDE`` words; fewer words are one run, none give none."""
    words = text.lower().split()
    n = len(words)
    width = min(WIDE, n)
    if not n:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * _ODD[1] + one[k : n - width + 1 + k]
        h ^= h >> np.uint64(29)
    h *= _ODD[0]
    h ^= h >> np.uint64(32)
    return np.unique(h * _ODD[1])


def sketch(text: bytes) -> tuple[np.ndarray, bytes]:
    """``COORDINATES`` minimum hashes, and the low byte (never 0) of the minimum in each bin, 0 in an empty one."""
    h = wide_shingles(text)
    mins, bins = np.zeros(COORDINATES, np.int32), np.zeros(BINS, np.uint8)
    if len(h):
        for k, m in enumerate(_RANDOM):
            mins[k] = int(((h * m) ^ (h >> np.uint64(31)) * m).min() >> np.uint64(33))
        which = (h >> np.uint64(56)).astype(np.int64)  # in order, as the hashes are
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        bins[which[first]] = ((h[first] >> np.uint64(8)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return mins, bins.tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in text_pieces(batches):
        made = [sketch(t) for t in texts]
        mins = pa.array(np.concatenate([m for m, _ in made]), pa.int32())
        offsets = pa.array(np.arange(0, len(mins) + 1, COORDINATES), pa.int32())
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "mins": pa.ListArray.from_arrays(offsets, mins), "bins": pa.array([b for _, b in made], pa.binary())})


def _with_key(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches):
            yield piece.append_column(name, pa.array([sketch_key(*sketch(t)) for t in texts], pa.int64()))

    return run


def sketch_key(mins: np.ndarray, bins: bytes) -> int:
    """One number for texts of one sketch."""
    return xxhash.xxh3_64_intdigest(mins.tobytes() + bins) - (1 << 63)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _sketches(batches):
        mins = b.column("mins").flatten().to_numpy().reshape(-1, COORDINATES)
        yield b.append_column("node", pa.array([sketch_key(m, x) for m, x in zip(mins, b.column("bins").to_pylist())], pa.int64()))


def similar_texts(docs: DataFrame) -> DataFrame:
    """(node, component_id, keep): of each distinct sketch its component, and the sketch of the component's smallest id."""
    ids = docs.select("doc_id", F.col("text").cast("string"))
    made = ids.mapInArrow(_keyed, f"doc_id {dict(ids.dtypes)['doc_id']}, mins array<int>, bins binary, node long")
    # a sketch is the same in all rows of a node
    distinct = save(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("bins").alias("bins"), F.min("mins").alias("mins")), "distinct-sketches")
    tables = F.array(*(F.struct(F.lit(i).alias("mask"), F.xxhash64(F.lit(i), *(F.col("mins")[k] for k in kept)).alias("bucket")) for i, kept in enumerate(SKETCH_MASKS)))
    keyed = distinct.select("node", F.explode(tables).alias("t")).select("node", "t.mask", "t.bucket")
    out = named_components(distinct.select("node", "least"), bucket_links(keyed, SimilarSketches, SKETCHES, distinct.select("node", "bins")))
    drop(distinct)
    return out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component of similar texts stays, one that has its smallest id.

    Of several rows of that id in one component those of the least sketch stay, and of rows alike
    in both any one. Texts are shuffled once, by id and sketch, so no group of copies meets in
    one task. A null id is compared as such, after all others; empty texts are copies of one
    another.
    """
    node, none, name = by = free_names(docs, "_node", "_none", "_name")
    marks = lambda c: (c.isNull().alias(none), F.coalesce(c.cast("string"), F.lit("")).alias(name))
    keep = similar_texts(docs).where(F.col("node") == F.col("keep")).select(F.col("node").alias(node), *marks(F.col("component_id")))
    marked = docs.mapInArrow(_with_key(node), docs.withColumn(node, F.lit(0).cast("long")).schema).select("*", *marks(F.col("doc_id")))
    return marked.join(keep, by, "left_semi").dropDuplicates(by).select(*docs.columns)
