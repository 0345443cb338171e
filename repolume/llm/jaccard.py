"""Similarity join of shingle sets by parity sketches.

Sets with Jaccard similarity p or more differ in at most T = (1-p)/(1+p) * (|A|+|B|) shingles.
For each band of sizes, T is taken for the band's largest sets, and the shingles are dealt by
hash into more than T blocks; a block's sketch is the XOR of its shingles' hashes. By the
pigeonhole principle similar sets agree in some block, so sets are joined on the sketches of
their blocks. A set takes part in its own band and in the next, where its larger partners are.

Frequent sketches, such as those of an empty block or of a passage that many texts share,
would join everything with everything. So there are more blocks than T + 1: similar sets
agree in at least 1 + EMPTY + SHARED blocks. A set with at most EMPTY empty blocks leaves
them out. Sets that share no more than SHARED sketches are not similar, so of the sketches
that a set shares with others it needs all but its SHARED most frequent ones.

Texts with equal sets are one node. First each node is joined with one node of each sketch
(a star); links that hold join nodes to components, and whatever lies within one component
needs no further look. Only sketches that still hold nodes of several components are joined
further, and there only nodes of different components. A second sketch of PARITY bits, in
which every shingle flips one bit, rules pairs out within the join: its Hamming distance
can't exceed the number of shingles in which two sets differ. Between sets of many more
shingles than PARITY that distance is always small, so parities of as many bits as the set has
shingles rule further pairs out, at a 64th to a 32nd of a set's bytes. What is left is verified
on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.llm.common import give_back, in_pieces, map_arrow, worker_state, written_swept
from repolume.llm.hashing import WordHashes, arrays_of, blob_of, mix, pieces, prefix_hashes

WORDS, PERCENT = 5, 80  # unless a caller asks for others
RUN_WORDS, RUN_ROWS = 500_000, 20_000  # words and texts that a task works on at once
GROUP_ROWS = 1_000_000  # sketches of one group
PARITY = 512
STARS = 4  # nodes drawn of each sketch in the second round
PARITIES = [f"parity_{i}" for i in range(PARITY // 64)]


def most_different(total: int, percent: int) -> int:
    """Shingles in which two sets of ``total`` shingles together may differ."""
    return total * (100 - percent) // (100 + percent)


def long_parity(shingles: np.ndarray) -> bytes:
    """The parity of the shingles that flip each bit, for as many bits as there are shingles: the
    next power of two, PARITY at least."""
    bits = max(PARITY, 1 << max(len(shingles) - 1, 0).bit_length())
    place = ((shingles >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits in which two long parities differ: no more than the shingles in which the sets do. The
    longer one is folded to the length of the other, which makes it the parity of fewer bits."""
    x, y = (np.frombuffer(p, np.uint64) for p in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Bands:
    """Sizes at which bands begin, and the blocks of each band. Sizes are below 2 ** 40."""

    def __init__(self, percent: int):
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts, np.int64)
        top = [most_different(2 * (end - 1), percent) for end in starts[1:]] + [0]
        self.most = np.array(top, np.int64)  # T; if 0, only equal sets are similar
        self.empty = 1 + (self.most + 1) // 24
        self.shared = 1 + (self.most + 1) // 4
        self.blocks = self.most + 1 + self.empty + self.shared

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1


class Sets:
    """Distinct shingles of neighbouring rows, as flat arrays."""

    def __init__(self, texts: list[np.ndarray], words: int):
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), size)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        fits = inner + words <= size[owner]
        shingles, owners = prefix_hashes(flat, words)[fits], owner[fits]
        for short in range(1, words):  # the whole sequence is the only shingle
            rows = np.flatnonzero(size == short)
            if len(rows):
                begin = (np.cumsum(size) - size)[rows]
                whole = prefix_hashes(flat, short)[begin]
                shingles = np.concatenate([shingles, mix(whole, np.full_like(whole, short))])
                owners = np.concatenate([owners, rows])
        order = np.lexsort((shingles, owners))
        shingles, owners = shingles[order], owners[order]
        fresh = np.ones(len(shingles), bool)
        fresh[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
        self.shingles, self.owners = shingles[fresh], owners[fresh]
        self.sizes = np.bincount(self.owners, minlength=len(texts))
        # a node is a set: the sum of its shingles' mixed hashes
        self.nodes = np.zeros(len(texts), np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            begin = (np.cumsum(self.sizes) - self.sizes)[some]
            mixed = mix(self.shingles, np.full_like(self.shingles, 77))
            total = np.add.reduceat(mixed, begin)
            self.nodes[some] = mix(total, self.sizes[some].astype(np.uint64))

    def set_of(self, row: int) -> np.ndarray:
        a, b = np.searchsorted(self.owners, [row, row + 1])
        return self.shingles[a:b]

    def parity(self) -> np.ndarray:
        """Rows x PARITY / 64 numbers: the parity of the shingles that flip each bit."""
        bit = (self.shingles >> np.uint64(20)) % np.uint64(PARITY)
        per_row = PARITY // 64
        out = np.zeros(len(self.sizes) * per_row, np.uint64)
        place = self.owners * per_row + (bit >> np.uint64(6)).astype(np.int64)
        np.bitwise_xor.at(out, place, np.uint64(1) << (bit & np.uint64(63)))
        return out.reshape(-1, per_row).view(np.int64)

    def sketches(self, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sketches, their rows, and how many of them similar sets share and need not, of every
        row that is the first of its node."""
        first = np.unique(self.nodes, return_index=True)[1]
        chosen = np.zeros(len(self.nodes), bool)
        chosen[first] = True
        chosen &= self.sizes > 0
        out = []
        own_band = bands.of(np.maximum(self.sizes, 1))
        for up in (0, 1):
            band = own_band + up
            blocks = np.where(chosen & (bands.most[band] > 0), bands.blocks[band], 0)
            begin = np.cumsum(blocks) - blocks
            used = blocks[self.owners] > 0
            token, owner = self.shingles[used], self.owners[used]
            mixed = mix(token, np.full_like(token, 5))
            block = ((mixed >> np.uint64(32)) * blocks[owner].astype(np.uint64)) >> np.uint64(32)
            place = begin[owner] + block.astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, value = place[order], mix(mixed, token)[order]
            total = int(blocks.sum())
            sketch = np.zeros(total, np.uint64)
            edges = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else []
            if len(edges):
                sketch[place[edges]] = np.bitwise_xor.reduceat(value, edges)
            full = np.zeros(total, bool)
            full[place] = True
            rows = np.repeat(np.arange(len(blocks)), blocks)
            number = np.arange(total) - begin[rows]
            # empty blocks count only where there are more of them than may be left out
            empty = np.bincount(rows[~full], minlength=len(blocks))
            kept = full | (empty > bands.empty[band])[rows]
            code = (band[rows] * 2 + 1).astype(np.uint64) << np.uint64(40)
            key = mix(sketch, code + number.astype(np.uint64))
            out.append((key[kept], rows[kept], bands.shared[band][rows][kept]))
        return tuple(np.concatenate(parts) for parts in zip(*out))


def _texts(batches: Iterator[pa.RecordBatch], words: int, most: int) -> Iterator[tuple[list, Sets]]:
    """Runs of rows: what stands before the text, and the sets. A-Z count as lower case. A run
    ends at ``most`` words or ``RUN_ROWS`` rows."""
    hashes = worker_state("jaccard-words", WordHashes)
    rows, texts, held = [], [], 0
    for batch in in_pieces(batches):
        for *row, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            texts.append(hashes.of((text or b"").lower()))
            held += len(texts[-1])
            if held >= most or len(rows) >= RUN_ROWS:
                yield rows, Sets(texts, words)
                rows, texts, held = [], [], 0
    if rows:
        yield rows, Sets(texts, words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def nodes_of(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, node, size, parities of every row; size 0 for a text without words."""
    run_words = RUN_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _texts(batches, words, run_words):
            ids, hashes = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(hashes, pa.int64()),
                    _signed(sets.nodes),
                    _signed(sets.sizes),
                    *(pa.array(column) for column in sets.parity().T),
                ],
                names=["doc_id", "text_hash", "node", "size", *PARITIES],
            )

    names = ("doc_id", "text_hash", "node", "size", *PARITIES)
    return map_arrow(texts, run, ", ".join(f"{name} long" for name in names))


def shared_sketches(texts: DataFrame, words: int, percent: int, groups: int) -> DataFrame:
    """sketch, node, spare: the sketches that several nodes have, each with all of its nodes.

    Sketches that several nodes of one run of rows have are known to be shared, and go on from
    there; one of the nodes takes part in the exchange, so a sketch meets there at most one
    node of each run, however many texts have it.
    """
    bands, run_words = Bands(percent), RUN_WORDS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches, words, run_words):
            key, row, spare = sets.sketches(bands)
            order = np.argsort(key, kind="stable")
            key, node, spare = key[order], sets.nodes[row][order], spare[order].astype(np.uint16)
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            shared = ~fresh
            shared[:-1] |= ~fresh[1:]
            found = []
            if shared.any():
                part = -1 - int(node[0] % np.uint64(groups))
                found.append((part, blob_of(key[shared], node[shared], spare[shared])))
            key, node, spare = key[fresh], node[fresh], spare[fresh]
            part = (key % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((node, part))  # a node's sketches stand together
            key, node, spare, part = key[order], node[order], spare[order], part[order]
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for a, b in zip(edges, np.append(edges[1:], len(part)) if len(edges) else []):
                own = node[a:b]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                many = np.diff(np.append(starts, b - a))
                found.append(
                    (
                        int(part[a]),
                        blob_of(key[a:b], own[starts], many.astype(np.uint32), spare[a:b]),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.binary()),
                ],
                names=["part", "blob"],
            )

    def meet(group: tuple, table: pa.Table) -> pa.Table:
        try:
            return met(group, table)
        finally:
            give_back()

    def met(group: tuple, table: pa.Table) -> pa.Table:
        blobs = [arrays_of(b) for b in table.column("blob").to_pylist()]
        if group[0].as_py() < 0:
            key, node, spare = (np.concatenate([b[i] for b in blobs]) for i in range(3))
        else:
            key = np.concatenate([b[0] for b in blobs])
            node = np.concatenate([np.repeat(b[1], b[2]) for b in blobs])
            spare = np.concatenate([b[3] for b in blobs])
            order = np.lexsort((node, key))
            key, node, spare = key[order], node[order], spare[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, spare = key[fresh], node[fresh], spare[fresh]
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            shared = same.copy()
            shared[:-1] |= same[1:]
            key, node, spare = key[shared], node[shared], spare[shared]
        return pa.table(
            [_signed(key), _signed(node), pa.array(spare.astype(np.int32))],
            names=["sketch", "node", "spare"],
        )

    dealt = map_arrow(texts, deal, "part long, blob binary")
    return dealt.groupBy("part").applyInArrow(meet, "sketch long, node long, spare int")


def _hamming() -> Column:
    """Bits in which the parities of a pair differ."""
    return sum(
        (F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0)
    )


def _may_be_similar(percent: int) -> Column:
    """Whether sizes and parities of a pair allow the similarity."""
    a, b = F.col("size_a"), F.col("size_b")
    allowed = F.floor((a + b) * (100 - percent) / F.lit(100 + percent))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (_hamming() <= allowed)


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components of (a, b) pairs; the root is the smallest node.

    Large and small stars in turn: every node hands its larger, then its smaller neighbours to
    the smallest one it knows, until nothing changes. Smallest neighbours are partial
    aggregates, so a node with very many neighbours is no large group.
    """
    spark = edges.sparkSession
    now = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u > v").distinct()
    now = written_swept(spark, now, "links")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = now.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = written_swept(spark, now, "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Join:
    """One similarity join: its tables in the shared folder, and the steps over them."""

    def __init__(self, documents: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        self.spark = documents.sparkSession
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.texts = documents.select(
            F.col("doc_id").cast("long"), text.alias("text")
        ).select(
            "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")
        )
        self.rows = written_swept(self.spark, nodes_of(self.texts, words), "set-nodes")
        total = self.rows.agg(F.sum("size")).first()[0] or 0
        self.groups = max(1, -(-total // GROUP_ROWS) // 2)
        self.nodes = written_swept(
            self.spark,
            self.rows.where("size > 0").groupBy("node").agg(
                *(F.first(c).alias(c) for c in ("size", *PARITIES))
            ),
            "distinct-sets",
        )
        shared = shared_sketches(self.texts, words, percent, self.groups)
        shared = written_swept(self.spark, shared.distinct(), "shared-sketches")
        # similar sets share more sketches of a band than there are to spare
        able = shared.groupBy("node", "spare").count().where("count > spare").drop("count")
        shared = shared.join(able, ["node", "spare"], "left_semi")
        self.shared = written_swept(self.spark, shared, "needed-sketches")
        self.sets = written_swept(self.spark, self._sets(), "compared-sets")
        self.roots = self.checked = None

    def side(self, name: str) -> DataFrame:
        """What a pair needs to know of its node ``name``."""
        return self.nodes.select(
            F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("size", *PARITIES))
        )

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs a < b that may be similar, with the distance of their parities."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.where("a < b").distinct()
        for name in ("a", "b"):
            pairs = pairs.join(self.side(name), name)
        return pairs.where(_may_be_similar(self.percent)).select(
            "a", "b", _hamming().alias("distance")
        )

    def _sets(self) -> DataFrame:
        """node, size, bits (its long parity), shingles (binary) of every node that may be compared,
        from one text of each."""
        wanted = self.shared.select("node").distinct()
        keys = (
            self.rows.where("size > 0")
            .select("node", F.struct("doc_id", "text_hash").alias("k"))
            .join(wanted, "node")
            .groupBy("node")
            .agg(F.min("k").alias("k"))
            .select("node", F.col("k.doc_id").alias("r_id"), F.col("k.text_hash").alias("r_hash"))
        )
        on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash"))
        texts = self.texts.join(keys, on).select("node", "text")
        words, run_words = self.words, RUN_WORDS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, sets in _texts(batches, words, run_words):
                for at in range(0, len(rows), 1000):
                    part = range(at, min(at + 1000, len(rows)))
                    own = [sets.set_of(i) for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([rows[i][0] for i in part], pa.int64()),
                            pa.array([len(s) for s in own], pa.int64()),
                            pa.array([long_parity(s) for s in own], pa.binary()),
                            pa.array([s.tobytes() for s in own], pa.binary()),
                        ],
                        names=["node", "size", "bits", "shingles"],
                    )

        # rows of equal id and text are one set
        columns = "node long, size long, bits binary, shingles binary"
        return map_arrow(texts, run, columns).dropDuplicates(["node"])

    def near(self, pairs: DataFrame) -> DataFrame:
        """a, b, near: whether the long parities of a pair allow the similarity."""
        for side in ("a", "b"):
            own = self.sets.select(
                F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("size", "bits"))
            )
            pairs = pairs.join(own, side)
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches):
                total, *bits = (c.to_pylist() for c in batch.columns[2:])
                near = [
                    parity_distance(a, b) <= most_different(n, percent)
                    for n, a, b in zip(total, *bits)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(near, pa.bool_())],
                    names=["a", "b", "near"],
                )

        total = (F.col("size_a") + F.col("size_b")).alias("total")
        columns = pairs.select("a", "b", total, "bits_a", "bits_b")
        return map_arrow(columns, run, "a long, b long, near boolean")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """a, b, similar: exact comparison of whole sets."""
        for side in ("a", "b"):
            pairs = pairs.join(
                self.sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side
            )
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches):
                similar = []
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    similar.append(100 * common >= percent * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(similar, pa.bool_())],
                    names=["a", "b", "similar"],
                )

        columns = pairs.select("a", "b", "set_a", "set_b")
        return map_arrow(columns, run, "a long, b long, similar boolean")

    def _add(self, pairs: DataFrame, name: str) -> DataFrame:
        """Verifies pairs, those that the long parities leave on their whole sets, and returns the
        components of all links so far: those of the links before, as stars, and the new links."""
        looked = written_swept(self.spark, self.near(pairs), f"{name}-near")
        whole = looked.where("near").select("a", "b")
        done = written_swept(self.spark, self.verify(whole), name)
        links = done.where("similar").select("a", "b")
        if self.roots is not None:
            links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        looked = looked.select("a", "b")
        self.checked = looked if self.checked is None else self.checked.unionByName(looked)
        self.roots = components(links)
        return self.roots

    def stars(self) -> DataFrame:
        """Pairs (a, b): each node with the smallest of each of its sketches."""
        least = self.shared.groupBy("sketch").agg(F.min("node").alias("a"))
        return (
            self.shared.join(least, "sketch")
            .where("node <> a")
            .select("a", F.col("node").alias("b"))
        )

    def mixed(self, roots: DataFrame, name: str) -> DataFrame:
        """sketch, node, spare, root, n of the sketches that hold several components."""
        held = self.shared.join(roots, "node", "left").withColumn(
            "root", F.coalesce("root", "node")
        )
        spread = (
            held.groupBy("sketch")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
            .where("low <> high")
            .select("sketch", "n")
        )
        return written_swept(self.spark, held.join(spread, "sketch"), name)

    def _met(self, left: DataFrame, right: DataFrame, among: bool = False) -> DataFrame:
        """Distinct pairs of nodes with a common sketch, of different components, that may be
        similar and have not been compared. ``among`` says that both sides are the same rows."""

        def end(rows: DataFrame, name: str) -> DataFrame:
            rows = rows.select(
                F.col("sketch").alias(f"sketch_{name}"),
                F.col("node").alias(name),
                F.col("root").alias(f"root_{name}"),
            )
            return rows.join(self.side(name), name)

        same = F.col("sketch_a") == F.col("sketch_b")
        apart = F.col("root_a") != F.col("root_b")
        if among:
            apart &= F.col("a") < F.col("b")
        pairs = end(left, "a").join(
            end(right, "b"), same & apart & _may_be_similar(self.percent)
        )
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return pairs.distinct().join(self.checked, ["a", "b"], "left_anti")

    def more_stars(self, held: DataFrame) -> DataFrame:
        """Pairs of each node with some nodes of each of its sketches, drawn by hashes."""
        drawn = [
            F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "root"))
            for i in range(STARS)
        ]
        drawn.append(F.min(F.struct(F.col("node").alias("h"), "node", "root")))
        centres = held.groupBy("sketch").agg(F.array_distinct(F.array(*drawn)).alias("c"))
        centres = centres.select("sketch", F.inline("c")).select("sketch", "node", "root")
        return self._met(centres.distinct(), held)

    def all_pairs(self, held: DataFrame) -> DataFrame:
        """Pairs of all nodes of each sketch; each set takes part with all but its most
        frequent sketches."""
        # a set's sketches of one band have the same number to spare
        own = Window.partitionBy("node", "spare")
        used = (
            held.withColumn("place", F.row_number().over(own.orderBy("n", "sketch")))
            .withColumn("many", F.count("*").over(own))
            .where(F.col("place") <= F.col("many") - F.col("spare"))
            .select("sketch", "node", "root")
        )
        used = written_swept(self.spark, used, "mixed-sketches")
        return self._met(used, used, among=True)

    def run(self) -> DataFrame:
        """node, root of all nodes that have a link."""
        stars = written_swept(self.spark, self.possible(self.stars()), "star-pairs")
        # one partner for each node first: most of the other pairs then lie within a component
        ends = stars.select(F.col("a").alias("node"), "a", "b", "distance").unionByName(
            stars.select(F.col("b").alias("node"), "a", "b", "distance")
        )
        nearest = ends.groupBy("node").agg(F.min(F.struct("distance", "a", "b")).alias("p"))
        roots = self._add(nearest.select("p.a", "p.b").distinct(), "nearest")
        roots = self._add(self.more_stars(self.mixed(roots, "mixed-once")), "more-stars")
        rest = self.all_pairs(self.mixed(roots, "mixed-twice"))
        rest = written_swept(self.spark, rest, "rest-of-pairs")
        return roots if rest.isEmpty() else self._add(rest, "rest")


def similar_documents(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, component for every row: the smallest id
    that links reach from the row, and a number of its component (null without words). Texts
    link at a Jaccard similarity of ``percent`` or more.

    A text with fewer than ``words`` words is one shingle; null and empty texts have none and
    link with nothing, not even with each other: their component is their own id. Rows of equal
    sets are linked, repeated rows included. Null ids take part but never name a component: a
    component of null ids alone has a null id. Only ``doc_id`` and ``text`` are read.
    """
    join = Join(documents, words, percent)
    roots = join.run()
    # smallest id of each set, then of each component
    own = join.rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = own.select("node", "root").join(named, "root")
    by_node = by_node.select("node", "component_id", F.col("root").alias("component"))
    with_set = join.rows.where("size > 0").join(by_node, "node")
    without = join.rows.where("size = 0").select(
        "*", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")
    )
    columns = [
        "doc_id", "text_hash", F.col("size").alias("n_shingles"), "component_id", "component"
    ]
    return with_set.select(*columns).unionByName(without.select(*columns))
