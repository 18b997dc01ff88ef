"""N-gram Jaccard join by signature trees: groups of documents whose shingle sets are similar.

Documents of one shingle set are one class. Classes that may be similar meet in blocks: a set is cut by
hash into more parts than two similar sets can differ in, so they agree in some whole parts; of a set's parts
just so many are left out that one of those always stays, the parts of the commonest shingles first. Classes
that share a part are joined through the part's smallest class, and a block is a component of that graph. A
large block is cut again by other parts, told apart by the shingles common in such blocks. In
each block a signature tree is built: its nodes hold the OR of their sets' token bitmaps, and the range
of set sizes; a dual traversal of the tree with itself skips node pairs whose largest possible overlap
is too small, or whose members are all linked already. What is left is compared exactly.

A block over a bound is dealt into chunks, each with the block's first classes as pivots; classes outside
its largest component so far are then compared with every chunk. So no link between components is lost,
no group is gathered whole, and pairs are never listed. Which shingles are common is found on a bounded
sample: it changes the size of blocks, never a link.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
a null id never names a component; repeated rows are one class; fewer words than a shingle make one
shingle; a very long text costs memory of about ten times its bytes where it is read, and is one set in its
block's task; empty tables give empty results; other columns are not read. Sets are compared by 64-bit hashes
of shingles, classes by a 64-bit hash of the set.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, groups, hashes_of, lean, mix, slices, texts_of, unused, written
from marginalia.llm.graph import Edges, components

SHINGLE = 4
THRESHOLD = (85, 100)
#: Bounds of a chunk: classes, and shingles of all its sets.
CHUNK_CLASSES = 1000
CHUNK_SHINGLES = 4_000_000
PIVOTS = 4
#: Rows of a few numbers (at most 40 bytes each) that are broadcast at once; more meet texts in several parts, and each other by shuffle.
BROADCAST_IDS = 500_000
#: Documents, or classes of large blocks, whose shingles are counted, and how many of them must have a common one; rounds of cutting large blocks again.
SAMPLE, COMMON, CUTS = 16384, 8, 2
#: Bytes of a signature that are kept besides its bucket.
SHORT = 5
#: Buckets of signatures for each shuffle partition.
BUCKETS = 4
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_NONE = np.zeros(0, np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def folded(text: str) -> bytes:
    """A text as UTF-8, A-Z lower-cased, white space as spaces."""
    return text.encode("utf-8", "replace").translate(_FOLD)


def words(text: str) -> list[bytes]:
    return folded(text).split()


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = hashes_of(folded(text))
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(size, len(w))):
        h += w[j : j + n] * _ODD[j % len(_ODD)] + np.uint64(j // len(_ODD))
    h = np.sort(mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_node(s: np.ndarray) -> int:
    """A set's class, as a signed 64-bit hash."""
    return int(np.int64(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)))


@cache
def bands(top: int, threshold: tuple[int, int]) -> np.ndarray:
    """Lower ends of size bands, each about 1.3 times the one before."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, -(-out[-1] * 13 // 10)))
    return np.array(out, np.int64)


def part_signatures(s: np.ndarray, threshold: tuple[int, int] = THRESHOLD, seed: int = 0, common: np.ndarray = _NONE) -> np.ndarray:
    """Hashes of parts such that different sets at the threshold share one.

    Two such sets, the larger of a band up to size u, differ in at most d = 2u(1-t)/(1+t) shingles, so of
    m > d parts m - d agree. Parts are in one order for all sets: the empty ones, then by their shingles that
    are not ``common``, by size, by hash. Each set leaves out its first m - d - 1: of the agreeing parts the
    set that leaves out more keeps one, which stands late enough for the other too.
    """
    num, den = threshold
    n = len(s)
    edges = bands(1 << max(8, (n * den // num + 1).bit_length()), threshold)
    lo, hi = np.searchsorted(edges, [n, n * den // num], "right") - 1
    mixed, out = None, []
    for b in range(lo, hi + 1):
        upper = int(edges[b + 1]) - 1
        d = 2 * upper * (den - num) // (den + num)
        if not d:
            continue
        if mixed is None:
            mixed = mix(s ^ _ODD[seed])
            rare = np.ones(n, bool) if not len(common) else common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s
            place = mix(s + _ODD[seed]) >> np.uint64(32) if seed else s >> np.uint64(32)
            if seed:
                order = np.argsort(place)
                place, mixed, rare = place[order], mixed[order], rare[order]
        m = d + max(2, -(-2 * d // 5))
        part = (place * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sig = mix(np.add.reduceat(mixed, starts) ^ mix(part[starts] + np.uint64((b + 1) << 32)))
        left_out = m - d - 1 - (m - len(starts))  # besides empty parts
        if left_out > 0:
            size = np.diff(np.append(starts, n))
            order = np.lexsort((sig, size, np.add.reduceat(rare.astype(np.int64), starts)))
            sig = sig[order[left_out:]]
        elif left_out < 0:
            none = np.setdiff1d(np.arange(m, dtype=np.uint64), part[starts])[left_out:]
            out.append(mix(mix(none + np.uint64((b + 1) << 32))))
        out.append(sig)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hubs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (signature, class): distinct signatures with their first class, and edges of the others to it."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    hub = node[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
    other = node != hub
    edges = np.unique(np.stack([node[other], hub[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    return sig[new], node[new], edges


_CELLS = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
_DDL = "bucket int, id long, row long, n long, a long, b long, x binary, y binary"


def _rows(count: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _CELLS], schema=_CELLS)


def _signed(sets: dict[int, np.ndarray], buckets: int, threshold: tuple[int, int], seed: int, common: np.ndarray, salt: np.ndarray | None = None):
    """Signatures of a slice's classes packed by bucket; those seen twice in the slice go as one, with an edge."""
    sigs = [part_signatures(s, threshold, seed, common) for s in sets.values()]
    if not sigs:
        return
    size = [len(x) for x in sigs]
    sig = np.concatenate(sigs)
    sig, hub, edges = _hubs(sig if salt is None else mix(sig ^ np.repeat(salt, size)), np.repeat(np.array(list(sets), np.int64), size))
    if edges.shape[1]:
        yield _rows(edges.shape[1], a=edges[0], b=edges[1], bucket=(edges[0] % buckets).astype(np.int32))
    cut = np.searchsorted((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    short = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]  # the bucket is of the highest bits; two that are taken for one make a block larger, no link
    yield _rows(len(full), bucket=full.astype(np.int32), x=[short[cut[k] : cut[k + 1]].tobytes() for k in full], y=[hub[cut[k] : cut[k + 1]].tobytes() for k in full])


def _whole(short: bytes) -> np.ndarray:
    """Signatures of ``SHORT`` bytes each as numbers."""
    out = np.zeros((len(short) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(short, np.uint8).reshape(-1, SHORT)
    return out.view("<u8")[:, 0]


def _met(signed: DataFrame, partitions: int) -> DataFrame:
    """Rows of documents as they are, and a forest of the edges between classes that share a signature, bucket by bucket."""

    def meet(batches):
        edges = Edges()
        rows_of = lambda found: (_rows(len(a), a=a, b=b) for a, b in found if len(a))
        for rows in groups(batches, "bucket"):
            is_doc, packed = rows.column("n").is_valid(), rows.column("x").is_valid()
            yield from rows.filter(is_doc).to_batches()
            plain, packed = rows.filter(pc.invert(pc.or_(is_doc, packed))), rows.filter(packed)
            yield from rows_of(edges.add(plain.column("a").to_numpy(), plain.column("b").to_numpy()))
            sig, node = (b"".join(packed.column(c).to_pylist()) for c in ("x", "y"))
            yield from rows_of(edges.add(*_hubs(_whole(sig), np.frombuffer(node, np.int64))[2]))
        yield from rows_of(edges.rest())

    return signed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), _DDL).select("id", "row", "n", "a", "b")


def survey(docs: DataFrame, size: int, threshold: tuple[int, int], common: np.ndarray = _NONE) -> DataFrame:
    """One pass over the texts: a row ``id, row, n, a = class`` per document, and rows ``a, b`` (no n) of classes that share a part."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions
    shared = spark.sparkContext.broadcast(common)

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(x, size) for x in texts_of(part)]
                node = [set_node(s) for s in sets]
                yield _rows(len(sets), id=part.column("id"), row=part.column("row"), n=[len(s) for s in sets], a=node, bucket=[i % buckets for i in range(len(node))])
                yield from _signed({k: s for k, s in zip(node, sets, strict=True) if len(s)}, buckets, threshold, 0, shared.value)

    return _met(docs.mapInArrow(lean(sign), _DDL), partitions)


def cut_again(sets: DataFrame, threshold: tuple[int, int], seed: int, common: np.ndarray) -> DataFrame:
    """``node, component`` of the classes of ``sets(node, block, x)`` that share a part of another cut within their block."""
    spark = sets.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(common)

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "x"):
                found = dict(zip(part.column("node").to_pylist(), (np.frombuffer(x, np.uint64) for x in part.column("x").to_pylist()), strict=True))
                block = dict(zip(part.column("node").to_pylist(), part.column("block").to_pylist(), strict=True))
                yield from _signed(found, BUCKETS * partitions, threshold, seed, shared.value, mix(np.array([block[k] for k in found], np.int64).view(np.uint64)))

    return components(_met(sets.select("node", "block", "x").mapInArrow(lean(sign), _DDL), partitions).select("a", "b"))


def sampled(rows: DataFrame, key: str, sample: int = SAMPLE) -> DataFrame:
    """Values of ``key``, at most ``sample``, chosen by hash."""
    return F.broadcast(rows.select(key).distinct().orderBy(F.xxhash64(key, F.lit(5)), key).limit(sample))


def common_shingles(rows: DataFrame, sets_of, least: int = COMMON) -> np.ndarray:
    """Sorted shingles that at least ``least`` of the sets of a sample have; they are counted on the executors."""

    def count(batches):
        for batch in batches:
            found = [s for s in sets_of(batch) if len(s)]
            if found:
                shingle, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n, pa.int64())], ["s", "n"])

    counts = rows.mapInArrow(lean(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(counts.select("s").toArrow()["s"].to_numpy().view(np.uint64))


class Tree:
    """A signature tree over sets, bulk loaded in order of size and first shingles.

    ``levels[0]`` has the sets; an upper entry stands for up to ``fan`` lower ones. ``excess`` is the most
    shingles by which a set below has more than bits.
    """

    def __init__(self, sets: list[np.ndarray], fan: int = 32):
        self.fan = fan
        sizes = np.array([len(s) for s in sets], np.int64)
        width = 1 << int(np.clip(int(8 * sizes.max()).bit_length(), 8, 15))
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i])))
        self.order, self.sets = order, [sets[i] for i in order]
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, s in zip(bits, self.sets, strict=True):
            at = s & np.uint64(width - 1)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.bits, self.low, self.high = [bits], [sizes[order]], [sizes[order]]
        self.excess = [sizes[order] - np.bitwise_count(bits).sum(1, dtype=np.int64)]
        while len(self.low) < 2 or len(self.low[-1]) > 1:
            starts = np.arange(0, len(self.low[-1]), fan)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], starts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.excess.append(np.maximum.reduceat(self.excess[-1], starts))


class Linker:
    """Links between sets, as few as connect each component.

    ``labels`` say what is linked already. With ``native``, only a native and another set are compared.
    """

    def __init__(self, sets: list[np.ndarray], labels: list[int] | None, threshold: tuple[int, int], native: list[bool] | None = None):
        self.tree, (self.num, self.den) = Tree(sets), threshold
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        if labels is not None:
            first: dict[int, int] = {}
            for i, k in enumerate(self.tree.order):
                self.parent[i] = first.setdefault(labels[k], i)
        self.whole: set[tuple[int, int]] = set()
        self.native = None if native is None else [np.array([native[k] for k in self.tree.order])]
        self.other = None if native is None else [~self.native[0]]
        while native is not None and len(self.native) < len(self.tree.low):
            for flags in (self.native, self.other):
                flags.append(np.logical_or.reduceat(flags[-1], np.arange(0, len(flags[-1]), self.tree.fan)))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def run(self) -> list[tuple[int, int]]:
        """Traverse the tree against itself, smaller subtrees first."""
        for i in range(len(self.tree.low[1])):
            self._pair(1, i, i)
        for level in range(2, len(self.tree.low)):
            for i in range(len(self.tree.low[level])):
                below = self._below(level, i)
                for x in below:
                    for y in range(x + 1, below.stop):
                        self._pair(level - 1, x, y)
        return [(self.tree.order[a], self.tree.order[b]) for a, b in self.links]

    def _below(self, level: int, i: int) -> range:
        return range(i * self.tree.fan, min((i + 1) * self.tree.fan, len(self.tree.low[level - 1])))

    def _single(self, level: int, i: int) -> int:
        """The component of all sets below an entry, or -1 if there are several."""
        if level and (level, i) not in self.whole:
            below = self._below(level, i)
            first = self._single(level - 1, below[0])
            if first < 0 or any(self._single(level - 1, x) != first for x in below[1:]):
                return -1
            self.whole.add((level, i))
        return self.find(i * self.tree.fan**level)

    def _possible(self, level: int, x: int, y: int) -> bool:
        """Whether some sets below x and y can be similar, by sizes and by bits in common."""
        t = self.tree
        low, high = t.low[level], t.high[level]
        if self.native and not (self.native[level][x] and self.other[level][y] or self.native[level][y] and self.other[level][x]):
            return False
        if high[x] * self.den < low[y] * self.num or high[y] * self.den < low[x] * self.num:
            return False
        most = int(np.bitwise_count(t.bits[level][x] & t.bits[level][y]).sum()) + int(min(t.excess[level][x], t.excess[level][y]))
        return most * (self.num + self.den) >= (low[x] + low[y]) * self.num

    def _pair(self, level: int, x: int, y: int) -> None:
        if (one := self._single(level, x)) >= 0 and one == self._single(level, y):
            return
        if not self._possible(level, x, y):
            return
        if level == 1:
            return self._leaves(self._below(1, x), self._below(1, y))
        for a in self._below(level, x):
            for b in self._below(level, y):
                self._pair(level - 1, a, b)

    def _leaves(self, xs: range, ys: range) -> None:
        """The same bound for all pairs of sets of two lowest nodes at once, then exact comparison of the rest."""
        t, a, b = self.tree, slice(xs.start, xs.stop), slice(ys.start, ys.stop)
        size, excess = t.low[0], t.excess[0]
        most = np.bitwise_count(t.bits[0][a][:, None] & t.bits[0][b][None]).sum(2, dtype=np.int64) + np.minimum(excess[a][:, None], excess[b][None])
        can = most * (self.num + self.den) >= (size[a][:, None] + size[b][None]) * self.num
        can &= np.array([self.find(i) for i in xs])[:, None] != np.array([self.find(i) for i in ys])[None]
        if self.native:
            can &= self.native[0][a][:, None] != self.native[0][b][None]
        for i, j in np.argwhere(can).tolist():
            i, j = i + xs.start, j + ys.start
            if self.find(i) != self.find(j) and self._similar(t.sets[i], t.sets[j]):
                self.parent[self.find(i)] = self.find(j)
                self.links.append((i, j))

    def _similar(self, s: np.ndarray, r: np.ndarray) -> bool:
        if len(s) > len(r):
            s, r = r, s
        at = np.searchsorted(r, s)
        common = int((r[np.minimum(at, len(r) - 1)] == s).sum())
        return common * self.den >= self.num * (len(s) + len(r) - common)


def _linked(work: DataFrame, threshold: tuple[int, int], partitions: int) -> DataFrame:
    """``a, b`` of links found in each chunk of ``work(block, chunk, node, label, native, x)``.

    A null label means that nothing is linked yet, and all sets of a chunk are compared; else only native
    sets with others.
    """

    def run(batches):
        key, node, label, native, sets = None, [], [], [], []

        def out():
            if len(sets) > 1:
                links = (Linker(sets, None, threshold) if label[0] is None else Linker(sets, label, threshold, native)).run()
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in a], pa.int64()), pa.array([node[i] for i in b], pa.int64())], ["a", "b"])

        for batch in batches:
            for k, c, i, g, own, x in zip(*(batch.column(f).to_pylist() for f in ("block", "chunk", "node", "label", "native", "x")), strict=True):
                if key != (k, c):
                    yield from out()
                    key, node, label, native, sets = (k, c), [], [], [], []
                if not node or node[-1] != i:  # rows come in order of node
                    node.append(i)
                    label.append(g)
                    native.append(own)
                    sets.append(np.frombuffer(x, np.uint64))
        yield from out()

    dealt = work.repartition(partitions, "block", "chunk").sortWithinPartitions("block", "chunk", "node")
    return dealt.select("block", "chunk", "node", "label", "native", "x").mapInArrow(lean(run), "a long, b long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, chunk_classes: int = CHUNK_CLASSES, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """``id, row, n, part, component`` for every row: row key, size of its set, its group (null without words), smallest id reachable by links."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    texts_sets = lambda batch: (shingle_set(x, size) for part in slices(batch, "text") for x in texts_of(part))
    common = common_shingles(source.join(sampled(source, "row"), "row", "left_semi"), texts_sets)
    seen = written(survey(source, size, threshold, common), "survey")
    rows = seen.where("n is not null").select("id", "row", "n", F.col("a").alias("node"))
    classes = written(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("n").alias("n")), "classes")
    blocks = written(components(seen.where("n is null").select("a", "b")).join(classes, "node").withColumnRenamed("component", "block"), "blocks")

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(x, size) for x in texts_of(part)]
                yield pa.RecordBatch.from_arrays([pa.array([set_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "x"])

    def with_sets(some: DataFrame) -> DataFrame:
        """Rows of classes (``node, least`` and more) with their sets, cut anew from texts that are not moved or kept."""
        sets = lambda ids, k, n: _part(source, "id", k, n).join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text").mapInArrow(lean(sets_of), "node long, x binary")
        parts = [(_part(some, "least", k, n), k, n) for n in [_parts(some)] for k in range(n)]
        return reduce(DataFrame.unionByName, [sets(mine.select(F.col("least").alias("wanted")).distinct(), k, n).join(F.broadcast(mine), "node") for mine, k, n in parts])

    chunks = F.greatest(F.ceil(F.count("*") / chunk_classes), F.ceil(F.sum("n") / chunk_shingles))
    counted = lambda blocks: written(blocks.join(blocks.groupBy("block").agg(chunks.alias("chunks")), "block"), "members")
    members = counted(blocks)
    for seed in range(1, CUTS + 1):
        large = members.where("chunks > 1")
        if large.isEmpty():
            break
        # sets are cut from the texts for the sample and for all, rather than kept: a block may hold most of them
        some = with_sets(written(large.join(sampled(large, "node"), "node", "left_semi").select("node", "least"), "sampled"))
        common = common_shingles(some.select("x"), lambda batch: (np.frombuffer(x, np.uint64) for x in batch.column("x").to_pylist()))
        again = cut_again(with_sets(large.select("node", "block", "least")), threshold, seed, common).join(large.select("node", "least", "n"), "node").withColumnRenamed("component", "block")
        members = counted(members.where("chunks = 1").select("node", "block", "least", "n").unionByName(again.select("node", "block", "least", "n")))
    is_hot = not members.where("chunks > 1").isEmpty()
    dealt = members.select("node", "least", "block", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    fresh = lambda df: df.withColumn("label", F.lit(None).cast("long")).withColumn("native", F.lit(True))
    work = fresh(with_sets(dealt))
    every_chunk = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    if is_hot:
        hot = dealt.where("chunks > 1")
        some = F.when(F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")) == 0, F.col("node"))
        firsts = hot.groupBy("block").agg(*[F.min(F.when(F.pmod(F.col("node"), F.lit(PIVOTS)) == i, some)).alias(f"p{i}") for i in range(PIVOTS)])
        firsts = firsts.select("block", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("node"))
        pivots = with_sets(written(hot.join(firsts, ["block", "node"]), "pivots")).withColumn("chunk", F.explode(every_chunk))
        work = work.unionByName(fresh(pivots))
    links = _linked(work, threshold, partitions)
    if is_hot:
        links = written(links, "links")
        labelled = hot.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        count = labelled.groupBy("block", "label").agg(F.count("*").alias("n"))
        largest = count.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        labelled = with_sets(written(labelled.join(largest, "block"), "labelled"))
        # a class outside the main component meets the native ones of every other chunk; of two such, each meets the other
        met = F.when(F.col("label") == F.col("main"), F.array("chunk")).otherwise(every_chunk)
        again = labelled.withColumn("met", met).withColumnRenamed("chunk", "own").withColumn("chunk", F.explode("met"))
        links = links.unionByName(_linked(again.withColumn("native", F.col("chunk") == F.col("own")), threshold, partitions))
    linked = written(components(links).join(classes, "node").select("node", F.col("component").alias("part"), "least"), "linked")
    least = written(linked.groupBy("part").agg(F.min("least").alias("component")), "least")
    linked = linked.join(_small(least), "part").select("node", "part", "component")
    # written, so that a join with the many rows of one class can be split
    of = written(classes.join(linked, "node", "left").select("node", F.coalesce("part", "node").alias("part"), F.coalesce("component", F.when(F.col("part").isNull(), F.col("least"))).alias("component")), "groups")
    found = rows.where("n > 0").join(of, "node").select("id", "row", "n", "part", "component")
    return found.unionByName(rows.where("n = 0").select("id", "row", "n", F.lit(None).cast("long").alias("part"), F.col("id").alias("component")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it has few rows (of a few numbers each)."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _parts(df: DataFrame) -> int:
    """In how many parts the rows of ``df`` are broadcast."""
    return max(1, -(-df.count() // BROADCAST_IDS))


def _part(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """The rows of part ``k`` of ``n`` by a key."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)) == k)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row."""
    return similar(docs, id_col, text_col, size, threshold).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of similar documents: that of the smallest id, of equals the first.

    ``docs`` is read twice and must come from files, so that both reads number the rows alike.
    """
    found = similar(docs, id_col, text_col, size, threshold).where("n > 0")
    key = unused(docs, "row")
    first = F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("stays")
    stays = written(found.groupBy("part").agg(first, F.count("*").alias("copies")).where("copies > 1").drop("copies"), "stays")
    gone = written(found.join(_small(stays), "part").where("row <> stays").select(F.col("row").alias(key)), "gone")
    kept, n = docs.withColumn(key, F.monotonically_increasing_id()), _parts(gone)
    for k in range(n):  # texts are never moved
        kept = kept.join(F.broadcast(_part(gone, key, k, n)), key, "left_anti")
    return kept.select(*docs.columns)
