"""N-gram Jaccard join with signature trees.

The top of the tree is an index of bitmap blocks: a text's shingles fall into as many blocks as two linked texts can
differ in, plus some, so linked texts hold equal blocks (the pigeonhole principle), and the trees of texts without a
common block are never compared. Blocks of few shingles, which unrelated texts may share by chance, count only for
texts with so many of them that a link could rest on those alone. Texts with equal shingles are one node throughout.

In each index entry the tree goes on below: nodes hold the OR of their members' token bitmaps and the range of their
set sizes, and a dual traversal drops node pairs whose largest possible overlap is too small. Nodes that surviving
pairs connect form a cluster; there the traversal is repeated with the shingles at hand and surviving pairs are
checked on all of them, unless they are connected already. Large clusters
are cut into parts by size and hash; each pair of parts whose sizes may link is a task of its own. Tasks return the
edges of spanning forests, so neither pairs of a group nor a whole group ever meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.llm.text import column
from rulelens.plans.components import components
from rulelens.plans.joins import BROADCAST_ROWS, checked_join
from rulelens.plans.scratch import save

#: Members of a part; clusters of at most two parts are one task; small clusters share tasks of so many members.
PART, SHARED = 512, 2000
LEAF, FANOUT = 16, 8
#: Sets of an index entry that are compared without a tree.
FEW = 6
#: Heads of a size class of a wide index entry.
HEADS = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[3]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of the whole sequence if it is shorter."""
    if n > len(_ODD):
        raise ValueError(f"shingles of more than {len(_ODD)} words are not supported")
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        return _mix((h * _ODD[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(words) - n + 1 + k] * _ODD[k]
    return np.unique(_mix(total))


# -- the index of blocks --------------------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def size_range(k: int, percent: int) -> tuple[int, int]:
    """Least and largest size of size class k: a set links within its own class and the two beside it only."""
    low = 1 if k == 0 else size_range(k - 1, percent)[1] + 1
    return low, low * 100 // percent


def size_class(size: int, percent: int) -> int:
    k = 0
    while size_range(k, percent)[1] < size:
        k += 1
    return k


@lru_cache(maxsize=100_000)
def blocks_of(k: int, percent: int) -> tuple[int, int, int]:
    """(blocks, slack, weak): sets of classes k and k+1 that link hold over ``slack`` equal blocks; a block of
    fewer than ``weak`` shingles is a weak one."""
    most = size_range(k, percent)[1] + size_range(k + 1, percent)[1]
    differ = (100 - percent) * most // (100 + percent)
    mean = size_range(k, percent)[0]
    for weak in (3, 2):
        for slack in range(2 + differ // 3):
            lam = mean / (differ + 1 + slack)
            few = sum(math.exp(-lam) * lam**j / math.factorial(j) for j in range(weak))
            expected = (differ + 1 + slack) * few
            if slack and expected + 2 * math.sqrt(expected) <= slack:
                return differ + 1 + slack, slack, weak
    return differ + 1, 0, 0


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's blocks, for pairs within its class and the next, and for pairs with the class below."""
    if not len(tokens):
        return np.empty(0, np.int64)
    own, out = size_class(len(tokens), percent), []
    for k in (own, own - 1) if own else (own,):
        blocks, slack, weak = blocks_of(k, percent)
        place = ((tokens >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        sizes = np.bincount(place, minlength=blocks)
        sums = np.zeros(blocks, np.uint64)
        filled = sizes > 0
        sums[filled] = np.add.reduceat(_mix(tokens[order] + _ODD[4]), (np.cumsum(sizes) - sizes)[filled])
        thin = sizes < weak
        use = ~thin if thin.sum() <= slack else np.ones(blocks, bool)
        where = np.flatnonzero(use).astype(np.uint64)
        out.append(_mix(sums[use] * _ODD[5] + where * _ODD[6] + np.uint64((k + 1) * int(_ODD[7]) & (1 << 64) - 1) + sizes[use].astype(np.uint64)))
    return np.concatenate(out).view(np.int64)


# -- the tree within a cluster --------------------------------------------------------------------------------------


class Tree:
    """Levels from leaves of LEAF sets up to one root: OR of bitmaps, size range, most shingles beyond one a bit, and
    the range of the labels if there are any."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None):
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, spare) + (() if labels is None else (labels, labels))]
        by = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        while len(self.levels[-1][1]) > 1:
            at = np.arange(0, len(self.levels[-1][1]), LEAF if len(self.levels) == 1 else FANOUT)
            self.levels.append(tuple(f.reduceat(v, at, axis=0) for f, v in zip(by, self.levels[-1], strict=False)))


def _possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a linked pair, by their largest possible overlap and least sizes."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 21) // x[0].shape[1])
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        most = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][a], y[3][b])
        most = np.minimum(np.minimum(most, x[2][a]), y[2][b])
        out[k : k + step] = (100 + percent) * most >= percent * (x[1][a] + y[1][b])
    return out


def _children(i: np.ndarray, j: np.ndarray, level: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    f = LEAF if level == 1 else FANOUT
    a = (i[:, None, None] * f + np.arange(f)[None, :, None]).repeat(f, axis=2).ravel()
    b = (j[:, None, None] * f + np.arange(f)[None, None, :]).repeat(f, axis=1).ravel()
    fits = (a < n) & (b < m)
    return a[fits], b[fits]


def dual(x: Tree, y: Tree | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of members of x and y, or within x; none of two members with one label."""
    other = y or x
    top = max(len(x.levels), len(other.levels)) - 1
    at = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(at(x, level)) > 4:
            (*_, low, high), (*_, low2, high2) = at(x, level), at(other, level)
            apart = (low[i] != high[i]) | (low2[j] != high2[j]) | (low[i] != low2[j])
            i, j = i[apart], j[apart]
        keep = _possible(at(x, level), i, at(other, level), j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            if y is None:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        for k in range(0, len(i), 256):
            a, b = _down(i[k : k + 256], j[k : k + 256], level, x, other)
            if y is None:
                a, b = a[a <= b], b[a <= b]
            stack.append((level - 1, a, b))


def _down(i: np.ndarray, j: np.ndarray, level: int, x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Children of node pairs; a tree that is lower keeps its root until the other has come down to it."""
    size = lambda t: len(t.levels[level - 1][1]) if level <= len(t.levels) - 1 else 0
    n, m = size(x), size(y)
    if n and m:
        return _children(i, j, level, n, m)
    f = LEAF if level == 1 else FANOUT
    if n:
        a = (i[:, None] * f + np.arange(f)).ravel()
        b = j.repeat(f)
        return a[a < n], b[a < n]
    b = (j[:, None] * f + np.arange(f)).ravel()
    a = i.repeat(f)
    return a[b < m], b[b < m]


def forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int, second: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets, or between those where ``second`` is false and true."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort(([int(s[0]) for s in sets], sizes))
    if second is not None:
        order = np.concatenate([order[~second[order]], order[second[order]]])
    nodes, sizes, sets = nodes[order], sizes[order], [sets[k] for k in order]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = np.split(flat, ends[:-1])
    width = int(min(1 << 13, max(1 << 8, 1 << int(2 * np.median(sizes)).bit_length())))
    marks = np.zeros((len(sets), width), bool)
    marks[np.repeat(np.arange(len(sets)), sizes), flat % width] = True
    bits = np.packbits(marks, axis=1).view(np.uint64)
    if second is None:
        pairs, shift = dual(Tree(bits, sizes), None, percent), 0
    else:
        shift = int((~second).sum())
        if shift in (0, len(sets)):
            return []
        pairs = dual(Tree(bits[:shift], sizes[:shift]), Tree(bits[shift:], sizes[shift:]), percent)
    parent, edges = np.arange(len(sets)), []
    flag = np.zeros(int(flat.max()) + 1, bool)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, j in pairs:
        j = j + shift
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            if not len(some):
                continue
            a = int(i[some[0]])
            root = find(a)
            left = [b for b in j[some].tolist() if find(b) != root]
            if not left:
                continue
            flag[ids[a]] = True
            held = np.add.reduceat(flag[np.concatenate([ids[b] for b in left])].astype(np.int64), np.cumsum([0, *(len(ids[b]) for b in left[:-1])]))
            flag[ids[a]] = False
            for b, common in zip(left, held.tolist(), strict=True):
                if 100 * common >= percent * (sizes[a] + sizes[b] - common) and (rb := find(b)) != (ra := find(a)):
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((int(nodes[a]), int(nodes[b])))
    return edges


# -- the jobs -------------------------------------------------------------------------------------------------------

_DIGESTS = "n_shingles long, node long, sketch binary"


def _width(size: int) -> int:
    """Bits of a set's bitmap: a power of two of its size at least, so that about half are set."""
    return 1 << min(16, max(6, int(size - 1).bit_length()))


def sketch(tokens: np.ndarray) -> bytes:
    marks = np.zeros(_width(len(tokens)), bool)
    marks[(tokens & np.uint64(len(marks) - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _digest(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for x in batch.column("_text"):
                tokens = shingles(x.as_py(), n)
                sizes.append(len(tokens))
                nodes.append(int(_mix(tokens + _ODD[0]).sum(dtype=np.uint64).view(np.int64)))
                sketches.append(sketch(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    return run


def _keys(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are indexed once
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for x in batch.slice(k, 256).column("_text"):
                    tokens = shingles(x.as_py(), n)
                    node = int(_mix(tokens + _ODD[0]).sum(dtype=np.uint64).view(np.int64))
                    if node not in seen:
                        seen.add(node)
                        keys.append(block_keys(tokens, percent))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return run


class Entries:
    """Index entries of one task, in turn: which of an entry's sets may link, less what is connected already."""

    def __init__(self, percent: int):
        self.percent, self.label = percent, {}

    def find(self, node: int) -> int:
        at = node
        while (up := self.label.get(at, at)) != at:
            at = up
        while (up := self.label.get(node, node)) != at:
            self.label[node], node = at, up
        return at

    def bits(self, sketches: list[bytes]) -> np.ndarray:
        """Bitmaps folded to the narrowest."""
        least = min(map(len, sketches))
        rows = [np.frombuffer(x, np.uint64) for x in sketches]
        return np.stack([r if len(r) * 8 == least else np.bitwise_or.reduce(r.reshape(-1, least // 8)) for r in rows])

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.find(a), self.find(b)
        self.label[max(ra, rb)] = min(ra, rb)
        return ra != rb

    def add(self, nodes: list[int], sizes: list[int], sketches: list[bytes]) -> list[tuple[int, int]]:
        if len(nodes) <= FEW:
            return self.few(nodes, sizes, [(int.from_bytes(x, "little"), len(x) * 8) for x in sketches])
        if len({self.find(x) for x in nodes}) == 1:
            return []
        bits, n = self.bits(sketches), np.array(sizes, np.int64)
        order = np.argsort(n, kind="stable")
        nodes, out = [nodes[k] for k in order], []
        labels = np.array([self.find(x) for x in nodes], np.int64)
        for i, j in dual(Tree(bits[order], n[order], labels), None, self.percent):
            out += [(nodes[a], nodes[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True) if self.join(nodes[a], nodes[b])]
        return out

    def few(self, nodes: list[int], sizes: list[int], bitmaps: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The bound of a tree's leaves for an entry of a few sets, where arrays would cost more than they save."""
        out = []
        for i in range(len(nodes)):
            for j in range(i):
                if self.find(nodes[i]) != self.find(nodes[j]) and self.fits(sizes[i], bitmaps[i], sizes[j], bitmaps[j]):
                    self.join(nodes[i], nodes[j])
                    out.append((nodes[i], nodes[j]))
        return out

    def fits(self, a: int, of_a: tuple[int, int], b: int, of_b: tuple[int, int]) -> bool:
        width = min(of_a[1], of_b[1])
        x, y = _folded(*of_a, width), _folded(*of_b, width)
        most = (x & y).bit_count() + min(a - x.bit_count(), b - y.bit_count())
        return (100 + self.percent) * min(most, a, b) >= self.percent * (a + b)


def _folded(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits | bits >> width) & (1 << width) - 1
    return bits


def _possible_links(percent: int):
    """Edges between sets of an index entry that may link; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, key, held = Entries(percent), None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n_shingles", "sketch")), strict=True):
                if row[0] != key:
                    if len(held) > 1:
                        out += entries.add(*map(list, zip(*held, strict=True)))
                    key, held = row[0], []
                held.append(row[1:])
            yield pa.RecordBatch.from_pydict({"a": [e[0] for e in out], "b": [e[1] for e in out]}, _EDGES)
        if len(held) > 1:
            out = entries.add(*map(list, zip(*held, strict=True)))
            yield pa.RecordBatch.from_pydict({"a": [e[0] for e in out], "b": [e[1] for e in out]}, _EDGES)

    return run


def _to_heads(percent: int):
    """Edges from sets of wide entries to those of their entry's heads that they may link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, bitmap = Entries(percent), lambda x: (int.from_bytes(x, "little"), len(x) * 8)
        for batch in batches:
            out = []
            for node, size, sketch, heads in zip(*(batch.column(c).to_pylist() for c in ("node", "n_shingles", "sketch", "heads")), strict=True):
                for head in heads:
                    a, b = size, head["n_shingles"]
                    if 100 * min(a, b) >= percent * max(a, b) and entries.find(node) != entries.find(head["node"]) and entries.fits(a, bitmap(sketch), b, bitmap(head["sketch"])):
                        entries.join(node, head["node"])
                        out.append((node, head["node"]))
            yield pa.RecordBatch.from_pydict({"a": [e[0] for e in out], "b": [e[1] for e in out]}, _EDGES)

    return run


def _between(percent: int):
    """Edges between the two sides of a pair of parts of a wide entry, where labels differ."""

    def run(table: pa.Table) -> pa.Table:
        sketches, node, label, sizes, second = (table.column(c).to_pylist() for c in ("sketch", "node", "label", "n_shingles", "second"))
        sides, out = [np.array([k for k in range(len(node)) if second[k] is s], np.int64) for s in (False, True)], []
        if all(map(len, sides)):
            entries = Entries(percent)
            entries.label = dict(zip(node, label, strict=True))
            bits, n, labels = entries.bits(sketches), np.array(sizes, np.int64), np.array(label, np.int64)
            sides = [s[np.argsort(n[s], kind="stable")] for s in sides]
            for i, j in dual(*(Tree(bits[s], n[s], labels[s]) for s in sides), percent):
                pairs = ((node[a], node[b]) for a, b in zip(sides[0][i].tolist(), sides[1][j].tolist(), strict=True))
                out += [(a, b) for a, b in pairs if entries.join(a, b)]
        return pa.Table.from_pydict({"a": [e[0] for e in out], "b": [e[1] for e in out]}, _EDGES)

    return run


def clusters_of(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of sets that may link, by the entries of ``shared`` (key, node).

    Entries of at most two parts are compared within one task. In a wider one each set is held against a few heads
    first. What these connect needs no comparing: only sets outside the entry's largest group meet all others, each
    pair of parts in a task of its own.
    """
    described = lambda rows: rows.join(sets.select("node", "n_shingles", "sketch"), "node")
    wide = save(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PART).select("key"), "join-wide")
    narrow = described(checked_join(shared, wide, ["key"], "left_anti"))
    near = narrow.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_possible_links(percent), "a long, b long")
    if wide.isEmpty():
        return components(near, "join-clusters")
    members = save(described(checked_join(shared, wide, ["key"], "inner")), "join-wide-members")
    mark = F.xxhash64("node")
    heads = members.groupBy("key", _class_of(F.col("n_shingles"), percent).alias("k"), F.pmod(mark, F.lit(HEADS)).alias("h")).agg(F.min(F.struct(mark.alias("mark"), "node", "n_shingles", "sketch")).alias("head"))
    heads = save(heads.groupBy("key").agg(F.collect_list("head").alias("heads")), "join-heads")  # a few a size class
    to_heads = checked_join(members, heads, ["key"], "inner").select("node", "n_shingles", "sketch", "heads").mapInArrow(_to_heads(percent), "a long, b long")
    clusters = components(near.unionByName(to_heads), "join-near")
    label = F.coalesce("component", "node").alias("label")
    members = save(members.join(clusters, "node", "left").select("key", "node", "n_shingles", "sketch", label), "join-labelled")
    groups = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    parts = lambda n: F.ceil(n / PART).cast("int")
    mixed = save(groups.where("n > main.n").select("key", F.col("main.label").alias("main"), parts(F.col("n")).alias("of_all"), parts(F.col("n") - F.col("main.n")).alias("of_others")), "join-mixed")
    if mixed.isEmpty():
        return clusters
    rows = checked_join(members, mixed, ["key"], "inner")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(mark, F.col(n)).cast("int")
    task = lambda a, b, second: F.struct(F.concat_ws(":", F.col("key").cast("string"), a.cast("string"), b.cast("string")).alias("task"), F.lit(second).alias("second"))
    met = F.transform(each("of_others"), lambda x: task(x, own("of_all"), True))
    meets = F.transform(each("of_all"), lambda x: task(own("of_others"), x, False))
    dealt = rows.select("node", "n_shingles", "sketch", "label", F.explode(F.when(F.col("label") == F.col("main"), met).otherwise(F.concat(met, meets))).alias("p")).select("node", "n_shingles", "sketch", "label", "p.*")
    rest = dealt.groupBy("task").applyInArrow(_between(percent), "a long, b long")
    return components(clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), "join-clusters")


def _tokens(n: int):
    """Shingles of the rows whose text is the named node's; another text of the same doc_id gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingles(x.as_py(), n) for x in part.column("_text")]
                right = part.column("node").to_numpy() == np.array([_mix(s + _ODD[0]).sum(dtype=np.uint64).view(np.int64) for s in sets], np.int64)
                sets = [s.view(np.int64) if r else np.empty(0, np.int64) for s, r in zip(sets, right, strict=True)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("cluster"), part.column("parts"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["node", "cluster", "parts", "tokens"])

    return run


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, node, two = (table.column(c).to_numpy() for c in ("cluster", "node", "second"))
        tokens, edges = table.column("tokens").combine_chunks(), []
        ends, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            if len(rows) > 1:
                sets = [flat[ends[r] : ends[r + 1]] for r in rows]
                second = two[rows]
                edges += forest(node[rows], sets, percent, None if not table.column("paired")[int(rows[0])].as_py() else second)
        return pa.Table.from_pydict({"a": [e[0] for e in edges], "b": [e[1] for e in edges]}, _EDGES)

    return run


def _class_of(size: Column, percent: int) -> Column:
    classes = [size_range(k, percent)[1] for k in range(size_class(1 << 40, percent))]
    return F.size(F.filter(F.array(*map(F.lit, classes)), lambda x: x < size))


def _parts(members: DataFrame, percent: int) -> DataFrame:
    """(node, cluster, parts): the tasks that each member goes to, with its side there."""
    members = members.withColumn("k", _class_of(F.col("n_shingles"), percent))
    counts = members.groupBy("cluster", "k").agg(F.count("*").alias("n"))
    counts = counts.select("cluster", F.struct("k", F.ceil(F.col("n") / PART).cast("int").alias("r")).alias("c"), "n")
    counts = counts.groupBy("cluster").agg(F.collect_list("c").alias("rs"), F.sum("n").alias("total"))  # one row a size class
    large = save(counts.where(F.col("total") > 2 * PART).select("cluster", F.map_from_entries("rs").alias("rs")), "join-large")
    small = save(counts.where(F.col("total") <= SHARED // 20).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("members")), "join-small")
    tasks = max(1, small.first()["members"] // SHARED)
    sized = counts.select("cluster", "total")
    named = checked_join(members.join(sized, "cluster"), large, ["cluster"])
    alone = F.array(F.struct(F.when(F.col("total") <= SHARED // 20, F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)))).otherwise(F.concat(F.lit("c"), "cluster")).alias("task"), F.lit(False).alias("paired"), F.lit(False).alias("second")))
    own = F.pmod(F.xxhash64("node"), F.try_element_at("rs", F.col("k"))).cast("int")
    named = named.withColumn("r", own)

    def task(ka, ra, kb, rb):
        return F.concat_ws(":", F.lit("p"), "cluster", ka, ra, kb, rb)

    each = lambda n: F.sequence(F.lit(0), n - 1)
    same = F.transform(each(F.try_element_at("rs", F.col("k"))), lambda r: F.struct(task(F.col("k"), F.least(r, F.col("r")), F.col("k"), F.greatest(r, F.col("r"))).alias("task"), (r != F.col("r")).alias("paired"), (F.col("r") > r).alias("second")))
    none = F.array().cast("array<struct<task:string,paired:boolean,second:boolean>>")
    above = F.when(F.try_element_at("rs", F.col("k") + 1).isNotNull(), F.transform(each(F.try_element_at("rs", F.col("k") + 1)), lambda r: F.struct(task(F.col("k"), F.col("r"), F.col("k") + 1, r).alias("task"), F.lit(True).alias("paired"), F.lit(False).alias("second")))).otherwise(none)
    below = F.when(F.try_element_at("rs", F.col("k") - 1).isNotNull(), F.transform(each(F.try_element_at("rs", F.col("k") - 1)), lambda r: F.struct(task(F.col("k") - 1, r, F.col("k"), F.col("r")).alias("task"), F.lit(True).alias("paired"), F.lit(True).alias("second")))).otherwise(none)
    return named.select("node", "cluster", F.when(F.col("rs").isNull(), alone).otherwise(F.concat(same, above, below)).alias("parts"))


def link(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Sets of ``n``-word shingles link if ``100 * intersection >= percent * union``; component_id is the least
    doc_id that links reach, the row's own included. Empty texts and nulls have no shingles and no links. Rows
    that share a doc_id are one document as far as links go; sets are told apart by 64-bit digests; a row without a doc_id has component_id null unless
    it equals a document with one. Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    digests = save(rows.mapInArrow(_digest(n), f"doc_id long, {_DIGESTS}"), "join-digests")
    filled = digests.where("n_shingles > 0 and doc_id is not null")
    # One row a set: the least doc_id that has it carries its text from here on.
    sets = save(filled.groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x")).select("node", "x.*"), "join-sets")
    held = rows.mapInArrow(_keys(n, percent), "key long, node long").repartition("key")
    entry = Window.partitionBy("key").orderBy("node")
    # Rows equal in key and node are copies of a text: one stays; an entry of one node is none.
    ranked = held.groupBy("key", "node").agg(F.lit(1).alias("_one")).withColumns({"_before": F.lag("node").over(entry), "_after": F.lead("node").over(entry)})
    shared = save(ranked.where("_before is not null or _after is not null").select("key", "node"), "join-shared")
    clusters = clusters_of(shared, sets, percent)
    members = save(clusters.withColumnRenamed("component", "cluster").join(sets.select("node", "n_shingles", "doc_id"), "node"), "join-members")
    parts = save(_parts(members.drop("doc_id"), percent).join(members.select("node", "doc_id"), "node"), "join-parts")
    texts = checked_join(rows.where("doc_id is not null"), parts, ["doc_id"], "inner")
    tokens = texts.select("node", "cluster", "parts", "_text").mapInArrow(_tokens(n), "node long, cluster long, parts array<struct<task:string,paired:boolean,second:boolean>>, tokens array<long>").where(F.size("tokens") > 0)
    dealt = tokens.select("node", "cluster", F.explode("parts").alias("p"), "tokens").select("p.task", "p.paired", "p.second", "node", "cluster", "tokens")
    edges = dealt.groupBy("task").applyInArrow(_link(percent), "a long, b long")
    # A document with several texts is one document: its sets are linked through it.
    several = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    same = filled.join(several, "doc_id").select("a", F.col("node").alias("b"))
    reached = components(edges.unionByName(same), "join-links")
    named = sets.select("node", "doc_id").join(reached, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = digests.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, that of the component's doc_id; columns as in ``docs``.

    Rows that share a doc_id are one document: of its rows that stay each text stays once, and an empty one is
    decided apart from the others, since it links with nothing. Rows without a doc_id all stay, and so does a
    document without words. An empty table gives no rows. Rows that stay are not shuffled while the ids of the
    others can be broadcast.
    """
    told = link(docs, n, percent, id_col, text_col).where("doc_id is not null")
    joined = save(told.select("doc_id", (F.col("n_shingles") > 0).alias("filled"), (F.col("component_id") == F.col("doc_id")).alias("stays")), "join-decided")
    each = joined.groupBy("doc_id", "filled").agg(F.count("*").alias("rows"), F.max("stays").alias("stays"))
    odd = save(each.where(~F.col("stays") | (F.col("rows") > 1)), "join-dropped")
    words = F.coalesce(column(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), words.alias("filled"), F.struct(*[column(c).alias(c) for c in docs.columns]).alias("row"))
    listed = odd.select("doc_id", "filled")
    alone = rows.join(F.broadcast(listed) if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else listed, ["doc_id", "filled"], "left_anti")
    repeated = rows.join(odd.where("stays").select("doc_id", "filled"), ["doc_id", "filled"], "left_semi").withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    return alone.unionByName(repeated.dropDuplicates(["doc_id", "text"]).drop("text")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
