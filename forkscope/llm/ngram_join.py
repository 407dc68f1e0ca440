"""Jaccard self-join of word n-gram sets with a prefix tree, as components.

Documents with equal sets are one class. Two sets that link share an n-gram
among the first few of either in a global order (the rest alone would be too
small an overlap); n-grams of rare words come first in that order and n-grams
of many documents last, so that few sets meet there by chance. Of those that
meet, parity marks rule out pairs that differ too much. Sets that are still
candidates, directly or over others, form a group, and all links lie within
groups. A group's sets are stored in a tree, most frequent
n-gram of the group first, so that alike sets share their paths: a set walks
down it, carrying the overlap on the way, and leaves subtrees whose remaining
length, or whose sizes, cannot reach the threshold. A subtree whose sets are
all known to belong to the walker's own component has nothing to add. Only a
spanning forest leaves the group, never all pairs.

Where very many sets meet, most are near copies of one text. So each is first
compared with one leader; what is near it, or links to it, is connected over it
and meets only the others: a group without others is done in one pass, however
large. The others, and those near the leader, are cut into blocks, and blocks
are joined in pairs of which one at least holds others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, shingles

WORDS, PERCENT = 4, 85
#: Shingles that two blocks of a group hold together, about; a larger group has a leader.
GROUP_SHINGLES = 4_000_000
#: What comes up so often in one task is counted over all tasks; the order knows the most frequent words and n-grams.
LOCAL_LEAST, FREQUENT, TALLIED = 4, 1 << 17, 1 << 20
#: Least number of bits of a set's parity marks; documents of an n-gram that are compared at once; with more than LED_ROWS it has a leader.
MARKS, BUCKET_ROWS, LED_ROWS = 1024, 4096, 256


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


class Node:
    __slots__ = ("edge", "children", "ends", "low", "high", "deep", "member", "uniform")

    def __init__(self, edge: np.ndarray, size: int, member: int, deep: int):
        self.edge, self.children, self.ends = edge, {}, []
        self.low = self.high = size
        self.deep, self.member, self.uniform = deep, member, True

    def take(self, size: int, member: int, deep: int, alone: bool) -> None:
        self.low, self.high, self.deep = min(self.low, size), max(self.high, size), max(self.deep, deep)
        self.uniform = self.uniform and alone


class PrefixTree:
    """Sets of ranks below `ranks`, with their full sizes (which may exceed the ranks stored), joined as they are added."""

    def __init__(self, ranks: int, percent: int):
        self.percent, self.root = percent, None
        self.parent: list[int] = []
        self.inside = np.zeros(ranks, bool)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def add(self, own: np.ndarray, size: int, with_member: int | None = None) -> None:
        """own: ascending. A set known to be in the component of another member is not compared."""
        member = len(self.parent)
        self.parent.append(member)
        if with_member is not None:
            self.union(member, with_member)
        if self.root is None:
            self.root = Node(own[:0], size, member, len(own))
        elif with_member is None:
            self.inside[own] = True
            self._walk(own, size, member)
            self.inside[own] = False
        self._insert(own, size, member)

    def _walk(self, own: np.ndarray, size: int, member: int) -> None:
        p, n = self.percent, len(own)
        #: (node, overlap before its edge)
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.uniform and self.find(node.member) == self.find(member):
                continue
            if 100 * node.high < p * size or 100 * size < p * node.low:
                continue
            need = p * (size + max(node.low, -(-p * size // 100)))  # (100 + p) * overlap >= p * (both sizes)
            edge = node.edge
            at = 0
            if len(edge):
                overlap += int(np.count_nonzero(self.inside[edge]))
                at = int(np.searchsorted(own, edge[-1], "right"))
            elif node is not self.root:
                continue
            if (100 + p) * (overlap + min(n - at, node.deep)) < need:
                continue
            for other_size, other in node.ends:
                if (100 + p) * overlap >= p * (size + other_size) and self.find(other) != self.find(member):
                    self.union(other, member)
            if not node.children:
                continue
            # Children begin beyond the edge; each of own's ranks skipped by then is lost.
            spare = (overlap + n - at) - -(-need // (100 + p))
            limit = own[at + spare] if at + spare < n else None
            near = []
            for first, child in node.children.items():
                if limit is None or first <= limit:
                    near.append((bool(self.inside[first]), child))
            near.sort(key=lambda x: x[0])
            stack += [(child, overlap) for _, child in near]  # those that share their first rank are looked at first

    def _insert(self, own: np.ndarray, size: int, member: int) -> None:
        node, at, root = self.root, 0, self.find(member)
        while True:
            node.take(size, member, len(own) - at, self.find(node.member) == root)
            if at == len(own):
                node.ends.append((size, member))
                return
            first = int(own[at])
            child = node.children.get(first)
            if child is None:
                leaf = Node(own[at:], size, member, 0)
                leaf.ends.append((size, member))
                node.children[first] = leaf
                return
            edge = child.edge
            m = min(len(edge), len(own) - at)
            differ = np.flatnonzero(edge[:m] != own[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(edge):
                middle = Node(edge[:same], child.low, child.member, len(edge) - same + child.deep)
                middle.high, middle.uniform = child.high, child.uniform
                child.edge = edge[same:]
                middle.children[int(edge[same])] = child
                node.children[first] = child = middle
            node, at = child, at + same


def joined(members: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[int]:
    """For each set (ascending distinct hashes) the index of the first set of its component. known: sets that are in one component already."""
    values, inverse, counts = np.unique(np.concatenate(members), return_inverse=True, return_counts=True) if members else (np.zeros(0),) * 3
    if not len(members):
        return []
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((np.arange(len(values)), -counts))] = np.arange(len(values))
    shared = int(np.count_nonzero(counts > 1))  # an n-gram of one set overlaps with none: only the set's size counts it
    ranks, ends = rank[inverse], np.cumsum([len(m) for m in members])
    tree = PrefixTree(shared, percent)
    known = np.zeros(len(members), bool) if known is None else known
    order = sorted(range(len(members)), key=lambda i: (not known[i], len(members[i]), i))
    for i in order:
        own = np.sort(ranks[ends[i] - len(members[i]) : ends[i]])
        tree.add(own[: int(np.searchsorted(own, shared))].astype(np.int32), len(members[i]), 0 if known[i] else None)
    first: dict[int, int] = {}
    for at, i in enumerate(order):
        root = tree.find(at)
        first[root] = min(first.get(root, i), i)
    out = [0] * len(members)
    for at, i in enumerate(order):
        out[i] = first[tree.find(at)]
    return out


class Tally:
    """Counts of the values of one task; the rest of a value that comes up once starts anew in long tasks, which only moves it in the order."""

    def __init__(self):
        self.held, self.waiting = [], 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def take(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.waiting += len(values)
        if self.waiting >= 1 << 20:
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.values, *self.held])
        counts = np.concatenate([self.counts, np.ones(len(every) - len(self.counts), np.int64)])
        order = np.argsort(every, kind="stable")
        v, c = every[order], counts[order]
        if len(v):
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            v, c = v[first], np.add.reduceat(c, first)
        if len(v) > TALLIED:
            v, c = v[c > 1], c[c > 1]
        self.values, self.counts, self.held, self.waiting = v, c, [], 0

    def rows(self, word: bool) -> pa.RecordBatch:
        self.merge()
        often = self.counts >= LOCAL_LEAST
        n = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array([word] * n, pa.bool_()), pa.array(self.values[often].view(np.int64)), pa.array(self.counts[often])], ["word", "hash", "n"])


def _counted(size: int):
    """How often the words of a task occur, and how many of its documents hold an n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Tally(), Tally()
        for batch in batches:
            for _, texts in shingles.slices(batch.column(0)):
                words.take(shingles.words(texts)[0])
                hashes, many = shingles.shingles(texts, size)
                owner = np.repeat(np.arange(len(many)), many)
                order = np.lexsort((owner, hashes))
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                grams.take(hashes[order[new]])
        yield words.rows(True)
        yield grams.rows(False)

    return count


class Order:
    """The global order: an n-gram's place is one number, made of its words' frequencies and its hash.

    N-grams of rare words come first, since they hardly meet by chance; those
    that many documents hold come last. Both tables are addressed by 22 bits of
    a hash; what shares a cell shares its fate, alike in all documents.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, grams: np.ndarray):
        self.weights, self.frequent = np.zeros(1 << 22, np.uint8), np.zeros(1 << 22, bool)
        at = (words.view(np.uint64) >> np.uint64(42)).astype(np.int64)
        np.maximum.at(self.weights, at, np.minimum(60, 1 + np.log2(counts)).astype(np.uint8))
        self.frequent[(grams.view(np.uint64) >> np.uint64(42)).astype(np.int64)] = True

    def place(self, hashes: np.ndarray, sums: np.ndarray) -> np.ndarray:
        first = np.where(self.frequent[(hashes >> np.uint64(42)).astype(np.int64)], np.uint64(255), sums.astype(np.uint64))
        return first << np.uint64(56) | hashes & np.uint64((1 << 56) - 1)


def _marks(own: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of the set's hashes fall on b: two sets differ in as many n-grams as marks at least. A power of two of bits, half the set's size at least."""
    bits = max(MARKS, 1 << (len(own) // 2).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(marks: np.ndarray, width: int) -> np.ndarray:
    """Marks of as many words by the same hashes with fewer bits."""
    while marks.shape[-1] > width:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def _described(order: Order, size: int, percent: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, prefixes, marks = [], [], [], [], []
            for _, own in shingles.sets(batch.column("text"), size, order.weights, order.place):
                n.append(len(own))
                one.append(int(np.bitwise_xor.reduce(own)) if len(own) else 0)
                two.append(int(shingles.mixed(own).sum(dtype=np.uint64)) if len(own) else 0)
                marks.append(_marks(own))
                prefixes.append(own[: len(own) - least_overlap(len(own), percent) + 1])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            signs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *signs, lists, pa.array(marks, pa.binary())], ["doc_id", "n", "one", "two", "prefix", "marks"])

    return describe


def _close(apart: np.ndarray, sizes: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets that differ in so many n-grams at least may link."""
    return ((100 + percent) * apart <= (100 - percent) * (sizes + other)) & (100 * np.minimum(sizes, other) >= percent * np.maximum(sizes, other))


def _near_leader(percent: int):
    """Rows have their leader's size and marks; adds whether a link with it is possible."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(len(batch), np.int64)
            for i, (a, b) in enumerate(zip(batch.column("marks").to_pylist(), batch.column("marks_l").to_pylist(), strict=True)):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                width = min(len(a), len(b))
                apart[i] = np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum(dtype=np.int64)
            known = _close(apart, batch.column("n").to_numpy(), batch.column("n_l").to_numpy(), percent)
            rest = batch.drop_columns(["n_l", "marks_l"])
            yield rest.append_column("known", pa.array(known | (batch.column("doc_id").to_numpy() == batch.column("leader").to_numpy())))

    return judge


def near(sizes: np.ndarray, marks: list[bytes], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect all sets whose sizes and marks leave a link possible, directly or over others.

    Those near the first one are connected over it and need no comparison among
    themselves; every other set is compared with all. known: sets that are
    connected already.
    """
    labels, pairs = np.arange(len(sizes)), []
    waiting = np.ones(len(sizes), bool)
    if known is not None and known.any():
        labels[known] = np.flatnonzero(known)[0]
        waiting[known] = False
    own = [np.frombuffer(m, np.uint64) for m in marks]
    width = np.array([len(m) for m in own])
    #: By width: which sets, and their marks folded to any smaller width.
    levels = {int(w): (at, {int(w): np.stack([own[k] for k in at])}) for w in np.unique(width) for at in [np.flatnonzero(width == w)]}
    for i in range(len(sizes)):
        if not waiting[i]:
            continue
        apart = np.zeros(len(sizes), np.int64)
        for w, (at, folded) in levels.items():
            least = min(w, int(width[i]))
            if least not in folded:
                folded[least] = _folded(folded[w], least)
            apart[at] = np.bitwise_count(folded[least] ^ _folded(own[i], least)).sum(1, dtype=np.int64)
        close = _close(apart, sizes, sizes[i], percent)
        for other in np.unique(labels[close]):
            if other != labels[i]:
                pairs.append((i, int(np.flatnonzero(close & (labels == other))[0])))
                labels[labels == other] = labels[i]
        if i == 0:
            waiting[close] = False
    return pairs


def _near_in_buckets(percent: int):
    """Rows come sorted by (gram, i, j), the key of a bucket."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def bucket() -> list[tuple[int, int]]:
            ids, sizes, known = (np.concatenate([h[k] for h in held]) for k in range(3))
            marks = [m for h in held for m in h[3]]
            return [(ids[i], ids[j]) for i, j in near(sizes, marks, percent, known)]

        for batch in batches:
            if not len(batch):
                continue
            found: list[tuple[int, int]] = []
            keys = np.stack([batch.column(c).to_numpy() for c in ("gram", "i", "j")], 1)
            ids, sizes, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "known"))
            marks = batch.column("marks").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = tuple(keys[a])
                if now != key and held:
                    found += bucket()
                    held = []
                key = now
                held.append((ids[a:b], sizes[a:b], known[a:b], marks[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            found = bucket()
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs


def _with_sets(size: int):
    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            row, held, weight = 0, [], 0
            for i, own in shingles.sets(batch.column("text"), size):
                held.append(own.tobytes())
                weight += len(held[-1])
                if weight > 16 << 20 or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([*rest.slice(row, len(held)).columns, pa.array(held, pa.binary())], [*rest.schema.names, "grams"])
                    row, held, weight = i + 1, [], 0

    return attach


def _linked_to_leader(percent: int):
    """Rows have their leader's n-grams; adds whether they link to it."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = []
            for a, b in zip(batch.column("grams").to_pylist(), batch.column("grams_l").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                known.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.drop_columns(["grams_l"]).append_column("known", pa.array(known, pa.bool_()))

    return judge


def _joined_cell(percent: int):
    def join(cell: pa.Table) -> pa.Table:
        ids = cell["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        grams = cell["grams"].combine_chunks()
        known = cell["known"].to_numpy()[order]
        roots = joined([np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in order], percent, known)
        ids = ids[order]
        return pa.table({"a": ids, "b": ids[roots] if len(ids) else ids})

    return join


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """rows (doc_id, blocks, ...) with i and j: where there are several blocks, a row goes to each pair with its own block."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _blocks(amount, most: int):
    """1 for what is compared at once, else so many that two hold as much together."""
    return F.when(amount > most, F.ceil(2 * amount / most)).otherwise(1).cast("int")


def _led_cells(judged: DataFrame, key: str, amount, most: int) -> DataFrame:
    """Cells (key, i, j) of judged rows (key, doc_id, known, ...): known ones meet only the others, in pairs of blocks.

    i and j are blocks of the others, or -1 - i is one of the known ones. A key
    without others has no cell.
    """
    sums = judged.groupBy(key).agg(F.coalesce(F.sum(F.when(~F.col("known"), amount)), F.lit(0)).alias("u"), F.coalesce(F.sum(F.when(F.col("known"), amount)), F.lit(0)).alias("r"))
    sums = sums.where("u > 0").select(key, _blocks(F.col("u"), most).alias("blocks"), _blocks(F.col("r"), most).alias("near"))
    rows = judged.join(sums, key)
    among = _in_block_pairs(rows.where("NOT known").drop("near"))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near_side = rows.where("known").withColumn("i", -1 - own("near")).withColumn("j", every("blocks"))
    far_side = rows.where("NOT known").withColumn("j", own("blocks")).withColumn("i", every("near")).withColumn("i", -1 - F.col("i"))
    return among.unionByName(near_side.drop("blocks", "near")).unionByName(far_side.drop("blocks", "near"))


def components_of(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; others are ignored).

    component_id is the smallest doc_id reachable over links: 100 * intersection
    >= percent * union of the sets of `size`-word shingles. Documents without
    words have no shingle and no link. Rows without doc_id take no part; rows
    that repeat a doc_id are all returned and count as linked to each other.
    """
    spark = docs.sparkSession
    common.modest_batches(spark)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = common.stored(docs.select("text").mapInArrow(_counted(size), "word boolean, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("n")), "counts")
    # FREQUENT pairs of numbers each at most; what is not among them still has its place in the order.
    words, grams = (counts.where(x).orderBy(F.desc("n"), "hash").limit(FREQUENT).select("hash", "n").toArrow() for x in ("word", "NOT word"))
    order = Order(words["hash"].to_numpy(), words["n"].to_numpy(), grams["hash"].to_numpy())
    shared = spark.sparkContext.broadcast(order)

    def describe(batches):
        return _described(shared.value, size, percent)(batches)

    rows = common.stored(docs.mapInArrow(describe, "doc_id long, n long, one long, two long, prefix array<long>, marks binary"), "sets")
    key = ["n", "one", "two"]
    # Only classes of several documents are joined back; a class of any size is counted with partial sums. Stored, and
    # joined by merging at every size, both sides are dealt out anew and the rows of a large class may be split.
    alike = rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    alike = common.stored(alike, "alike")
    known = rows.join(alike.hint("merge"), key, "left").withColumn("node", F.coalesce("first", "doc_id"))
    first = common.stored(known.where("n > 0 AND node = doc_id").select("doc_id", "n", "prefix", "marks"), "classes")
    grams = first.select("doc_id", F.explode("prefix").alias("gram"))
    # Buckets of the same documents are one: the number and the joint hash of a bucket's documents tell.
    met = grams.groupBy("gram").agg(F.count("*").alias("many"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bit_xor(F.xxhash64("doc_id")).alias("sign"), F.sum(F.xxhash64("doc_id") % (1 << 31)).alias("total")).where("low <> high")
    met = met.groupBy("many", "low", "high", "sign", "total").agg(F.min("gram").alias("gram"))
    held = first.select("doc_id", "n", "marks")
    # Stored once for both kinds of buckets: those with a leader and the others.
    buckets = grams.join(met.select("gram", F.when(F.col("many") > LED_ROWS, F.col("low")).alias("leader")), "gram").join(held, "doc_id")
    buckets = common.stored(buckets.select("gram", "doc_id", "n", "marks", "leader"), "buckets")
    small = buckets.where("leader IS NULL").select("gram", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc_id", "n", F.lit(False).alias("known"), "marks")
    # Merged at every size, so that the rows of a large bucket may be split; its leader is one row.
    led = buckets.where("leader IS NOT NULL")
    leaders = led.where("doc_id = leader").select("gram", F.col("n").alias("n_l"), F.col("marks").alias("marks_l")).dropDuplicates(["gram"])
    judged = led.join(leaders.hint("merge"), "gram").mapInArrow(_near_leader(percent), "gram long, doc_id long, n long, marks binary, leader long, known boolean")
    judged = common.stored(judged, "judged")
    order_by = ["gram", "i", "j"]
    cells = small.unionByName(_led_cells(judged.drop("leader"), "gram", F.lit(1), BUCKET_ROWS))
    cells = cells.repartition(common.partitions(spark), *order_by).sortWithinPartitions(*order_by)
    edges = cells.select(*order_by, "doc_id", "n", "known", "marks").mapInArrow(_near_in_buckets(percent), "a long, b long")
    edges = edges.union(judged.where("known AND doc_id <> leader").select("leader", "doc_id"))
    groups = components.connected(edges)
    groups = groups.union(groups.select("component", "component").distinct()).toDF("doc_id", "g")
    members = common.stored(groups.join(rows.where("n > 0").groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "groups")
    weights = common.stored(members.groupBy("g").agg(F.sum("n").alias("weight")), "weights")

    def sets_of(groups: DataFrame) -> DataFrame:
        texts = docs.join(members.join(groups.select("g"), "g").select("doc_id", "g", "n"), "doc_id")
        return texts.mapInArrow(_with_sets(size), "doc_id long, g long, n long, grams binary")

    cells = sets_of(weights.where(F.col("weight") <= GROUP_SHINGLES)).withColumn("known", F.lit(False))
    links = common.stored(cells.select("doc_id", "g", "grams", "known").groupBy("g").applyInArrow(_joined_cell(percent), "a long, b long").where("a <> b"), "links")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    large = weights.where(F.col("weight") > GROUP_SHINGLES)
    if large.limit(1).count():
        # A group's leader is its smallest document, for which it is named.
        sets = common.stored(sets_of(large), "large")
        judged = sets.join(sets.where("doc_id = g").select("g", F.col("grams").alias("grams_l")).dropDuplicates(["g"]).hint("merge"), "g")
        judged = common.stored(judged.mapInArrow(_linked_to_leader(percent), "g long, doc_id long, n long, grams binary, known boolean"), "judged")
        cells = _led_cells(judged, "g", F.col("n"), GROUP_SHINGLES).select("doc_id", "g", "i", "j", "grams", "known")
        among = cells.groupBy("g", "i", "j").applyInArrow(_joined_cell(percent), "a long, b long").where("a <> b")
        found = found.union(components.connected(among.union(judged.where("known").select("doc_id", "g").where("doc_id <> g"))))
    return known.select("doc_id", "n", "node").join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 0.85 on four-word shingles."""
    return components_of(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams
    FROM w
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (
    WITH RECURSIVE t(node, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT t.node, e.b FROM t JOIN e ON t.other = e.a)
    SELECT node, min(other) AS component_id FROM t GROUP BY node
)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, r.component_id FROM s JOIN r ON s.doc_id = r.node
"""
