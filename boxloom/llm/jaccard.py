"""N-gram Jaccard join (operator 2): a prefix-tree join over globally ordered shingle sets.

A document's set holds the 64-bit hashes of its distinct shingles (three words in op2), in ascending order: one global
order for all documents. Two sets link when DEN * |A and B| >= NUM * |A or B| (90 and 100 in op2), so at most
(DEN - NUM) / (DEN + NUM) of the |A| + |B| elements differ, 1 / 19 in op2. Cutting the ordered hash range of a size
class into more segments than that leaves equal segments in any linked pair; the segment keys route sets to blocks,
without a bound on their number. Keys travel packed, by range, and only those that sets share are written as rows.
Parity sketches of the sets, a bit an element, then bound from below in how many elements two sets of a block
differ; sets that may link with no other one of a block are left out, and those that may form groups. Only their texts
are read again. Every comparison is then made in a trie over a bounded cell: `SetTrie` shares the overlap of a common
path among all sets below it and leaves a subtree as soon as the remaining lengths cannot reach the needed overlap.

Groups of bounded size are compared whole. In a larger group each set is first compared with a pivot of its blocks (a
star: linear in the group); blocks whose sets are then one component are done, and in the others only sets of
different components are compared. No pair is emitted unless it is a verified link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import mix, sieve, small_batches, staged, table, text_hash, windows, word_hashes

_U = np.uint64
#: Words of a shingle and the least similarity NUM / DEN of op2.
WORDS, NUM, DEN = 3, 90, 100
#: A cell holds about so many sets, or sets with so many elements together.
CELL_SETS, CELL_ELEMENTS = 2048, 4_000_000
#: Sets that blocks connect are compared as one group if it has no more sets than this; larger ones start with a star.
GROUP = 2048
#: Keys of a run that go on together, and of a bucket about; sets of a block that sketches are read of.
ROUTE, BLOCK = 1_000_000, 4096


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The ordered hash set of a text: distinct n-word shingles, the whole sequence as one if shorter."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    if len(words) < n:
        whole = words[:1] + _U(len(words))
        for i in range(1, len(words)):
            whole = mix(whole) ^ words[i : i + 1]
        return mix(whole)
    return np.unique(windows(words, n))


@lru_cache(maxsize=16)
def _bounds(num: int, den: int) -> np.ndarray:
    """The largest sizes of the size classes; in the first, only equal sets link."""
    out = [-(-den // (den - num)) - 1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


@lru_cache(maxsize=256)
def _segments(level: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The inner cuts of the hash range at a level, and a label for each segment."""
    differ = int(2 * _bounds(num, den)[level] * (den - num) // (den + num))
    # some more where segments are so short that several may be empty; none at 0.9 but for very large sets
    parts = differ + 2 + int(4 * math.exp(-(den + num) / (2 * (den - num))) * (differ + 40))
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return cuts, mix(np.arange(parts, dtype=np.uint64) + _U(level << 40))


def segment_keys(h: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The keys of a set's segments, for its size class and for those above where a larger partner may be.

    A segment is a range of the global order; only segments with elements have keys. Where these are more than the
    elements that can differ, one of them is equal in any partner. Else, which is rare, each of the set's first
    elements has a key as well: of two such sets that link, the first elements have one in common.
    """
    n = len(h)
    bounds = _bounds(num, den)
    levels = range(max(int(np.searchsorted(bounds, n)), 1), int(np.searchsorted(bounds, n * den // num)) + 1) if n else ()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h ^ _U(0xD6E8FEB86659FD93)), out=sums[1:])
    out = []
    for level in levels:
        cuts, label = _segments(level, num, den)
        cut = np.concatenate(([0], np.searchsorted(h, cuts), [n]))
        size = np.diff(cut)
        differ = (n + min(int(bounds[level]), n * den // num)) * (den - num) // (den + num)
        full = size > 0
        key = mix((sums[cut[1:]] - sums[cut[:-1]]) + label + size.astype(np.uint64) * _U(0xA0761D6478BD642F))
        out.append(key[full])
        if np.count_nonzero(full) <= differ:
            out.append(mix(h[: n - -(-num * n // den) + 1] + label[0]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """The parity of the elements that fall on each of some bits, about as many as there are elements.

    Each element in which two sets differ turns one bit at most, so sets differ in no fewer elements than their
    sketches in bits. Half the bits follow by `fold`.
    """
    bits = max(128, 1 << max(len(h) - 1, 0).bit_length())
    odd = np.bincount((mix(h ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _profile(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(x.as_py(), words) for x in part.column(1)]
                digests = [set_digest(h) for h in sets]
                columns = [part.column(0), part.column(2), pa.array([len(h) for h in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([_node(d) for d in digests], pa.int64())]
                sketch = pa.array([parity_sketch(h).tobytes() if len(h) else None for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, sketch], names=["doc_id", "text_hash", "n_shingles", "digest", "node", "sketch"])

    return run


_ROUTE = "bucket long, keys binary, nodes binary, at binary"


def _routes(words: int, num: int, den: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The keys of texts, by bucket of the key range: 48 bits of each key in byte planes, and which node it is of.

    Keys that several sets of a run of ROUTE keys have in common go on once, with one of these sets; all of them go
    to a bucket under zero by the set, where they are only written. So a key that very many sets share costs its
    bucket a row a run.
    """

    def flush(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        node = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys) >> _U(16)
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        many = np.repeat(np.diff(np.append(np.flatnonzero(first), len(key))) > 1, np.diff(np.append(np.flatnonzero(first), len(key))))
        rows = []
        if many.any():
            place = (mix(node[many].view(np.uint64)) % _U(buckets)).astype(np.int64)
            for i in np.unique(place):
                rows.append((-1 - int(i), key[many][place == i].tobytes(), node[many][place == i].tobytes(), None))
        key, node = key[first], node[first]
        bucket = (key >> _U(16)) * _U(buckets) >> _U(32)
        ends = np.flatnonzero(np.concatenate((bucket[1:] != bucket[:-1], [True]))) + 1
        start = 0
        for end in ends:
            names, at = np.unique(node[start:end], return_inverse=True)
            rows.append((int(bucket[start]), key[start:end].view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), names.tobytes(), at.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()))
            start = end
        return pa.RecordBatch.from_pylist([dict(zip(("bucket", "keys", "nodes", "at"), r, strict=True)) for r in rows], pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("nodes", pa.binary()), ("at", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for x in batch.column(0):
                h = shingles(x.as_py(), words)
                node = _node(set_digest(h)) if len(h) else 0
                if len(h) and node not in keys:
                    keys[node] = np.unique(segment_keys(h, num, den) >> _U(16)) << _U(16)
                    held += len(keys[node])
                if held >= ROUTE:
                    yield flush(list(keys.values()), list(keys))
                    keys, held = {}, 0
        if held:
            yield flush(list(keys.values()), list(keys))

    return run


def _planes(raw: bytes, width: int, size: int) -> np.ndarray:
    """Whole numbers of so many bytes from their byte planes, filled up to `size` bytes."""
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(f"<u{size}")


def _meet(group: pa.Table) -> pa.Table:
    """(key, node) of the keys in a bucket that several nodes share."""
    rows = group.to_pylist()
    if rows[0]["bucket"] < 0:
        key, node = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("keys", "nodes"))
        return pa.table({"key": key, "node": node})
    key = np.concatenate([_planes(r["keys"], 6, 8) for r in rows]).view(np.int64)
    node = np.concatenate([np.frombuffer(r["nodes"], np.int64)[_planes(r["at"], 3, 4)] for r in rows])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    one = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
    key, node = key[one], node[one]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    many = np.repeat(size > 1, size)
    return pa.table({"key": key[many], "node": node[many]})


def _admitted(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (key, node, n, sketch), those of a key together: pairs (a, b) that connect all sets of a key whose sketches let them link."""

    def block(nodes: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
        least = min(map(len, sketches)) // 8
        m = np.array([fold(np.frombuffer(s, np.uint64), least) for s in sketches])
        open_, out = np.ones(len(nodes), bool), []
        for seed in range(len(nodes)):  # each component of the pairs that may link, breadth first
            if not open_[seed]:
                continue
            open_[seed], todo = False, [seed]
            while todo:
                i = todo.pop()
                rest = np.flatnonzero(open_)
                rest = rest[(den * n[rest] >= num * n[i]) & (num * n[rest] <= den * n[i])]
                near = rest[(den + num) * np.bitwise_count(m[rest] ^ m[i]).sum(axis=1, dtype=np.int64) <= (n[rest] + n[i]) * (den - num)]
                open_[near] = False
                todo.extend(near.tolist())
                out.extend((int(nodes[i]), int(nodes[j])) for j in near)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        found: set[tuple[int, int]] = set()
        edges = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

        def blocks(rows: pa.Table) -> None:
            key, node, n = (rows.column(c).to_numpy() for c in ("key", "node", "n"))
            sketch = rows.column("sketch").to_pylist()
            at = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s > 1:
                    found.update(block(node[s:e], n[s:e], sketch[s:e]))

        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if not rows.num_rows:
                continue
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            rest = rows.slice(last)
            if last:
                blocks(rows.slice(0, last))
            if len(found) >= 100_000:
                yield edges()
                found.clear()
        if rest is not None:
            blocks(rest)
        yield edges()

    return run


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the set to (text, node, ...); rows whose text is of another node go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingles(x.as_py(), words) for x in part.column(0)]
                own = [_node(set_digest(h)) for h in sets]
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([h.tobytes() for h in sets], pa.binary())], names=[*part.schema.names[1:], "set"])
                yield out.filter(pa.array([a == b for a, b in zip(own, part.column(1).to_pylist(), strict=True)], pa.bool_()))

    return run


class SetTrie:
    """A compressed trie of ascending sets; an edge holds a run of elements.

    Sets link from a similarity of num / den. root(name) tells the component of a set. Components only ever merge, so a
    subtree whose sets were of one component stays so, and a query that has joined that component need not enter it.
    """

    __slots__ = ("kids", "most", "fewest", "ends", "run", "any", "pure", "num", "den", "up", "live", "stamp", "home")

    def __init__(self, run: np.ndarray, num: int = NUM, den: int = DEN, up: SetTrie | None = None):
        self.num, self.den, self.up = num, den, up
        self.run = run  # the elements on the edge to this node
        self.kids: dict[int, SetTrie] = {}
        self.ends: list[int] = []  # the sets that end here
        self.most, self.fewest = 0, 1 << 62  # sizes of the sets below
        self.any, self.pure = -1, True  # one set below; whether all are of its component
        self.live: list[SetTrie] = []  # kids on the way to a set that the query may link with
        self.stamp = 0  # the query that marked the node; at the top, the number of queries
        self.home: dict[int, SetTrie] = {}  # at the top: the node where each set ends

    def add(self, h: np.ndarray, name: int, root: Callable[[int], int]) -> None:
        node, at, n = self, 0, len(h)
        while True:
            node.most, node.fewest = max(node.most, n), min(node.fewest, n)
            if node.any < 0:
                node.any = name
            elif node.pure:
                node.pure = root(node.any) == root(name)
            if at == n:
                node.ends.append(name)
                self.home[name] = node
                return
            kid = node.kids.get(int(h[at]))
            if kid is None:
                kid = node.kids[int(h[at])] = SetTrie(h[at:], self.num, self.den, node)
                kid.most = kid.fewest = n
                kid.any = name
                kid.ends.append(name)
                self.home[name] = kid
                return
            same = min(len(kid.run), n - at)
            differ = np.flatnonzero(kid.run[:same] != h[at : at + same])
            same = int(differ[0]) if len(differ) else same
            if same < len(kid.run):  # split the edge
                upper = SetTrie(kid.run[:same], self.num, self.den, node)
                upper.most, upper.fewest, upper.any, upper.pure = kid.most, kid.fewest, kid.any, kid.pure
                kid.run, kid.up = kid.run[same:], upper
                upper.kids[int(kid.run[0])] = kid
                node.kids[int(h[at])] = upper
                kid = upper
            node, at = kid, at + same

    def _mark(self, names: list[int]) -> None:
        """Lets a query see the ways to these sets only."""
        self.stamp += 1
        self.live = []
        for name in names:
            node, below, new = self.home[name], None, True
            while new:
                new = node is not self and node.stamp != self.stamp
                if new:
                    node.stamp, node.live = self.stamp, []
                if below is not None:
                    node.live.append(below)
                below, node = node, node.up

    def search(self, q: np.ndarray, root: Callable[[int], int], own: Callable[[], int], names: list[int] | None = None) -> Iterator[int]:
        """Names of sets that link with q, at least one of each component but own(), that of q by now.

        With names, only these sets are looked for. The stack holds (node, depth, overlap so far, elements of q passed).
        """
        n, num, den = len(q), self.num, self.den
        if names is not None:
            self._mark(names)
        below = (lambda node: node.kids.values()) if names is None else (lambda node: node.live)
        wanted = None if names is None else set(names)
        stack = [(kid, 0, 0, 0) for kid in below(self)]
        while stack:
            node, depth, overlap, passed = stack.pop()
            if node.pure and root(node.any) == own():
                continue
            # the smallest set below asks for the least overlap; sizes too far apart never link
            least = max(node.fewest, -(-num * n // den))
            most = min(node.most, den * n // num)
            if least > most:
                continue
            need = -(-num * (n + least) // (num + den))
            if overlap + min(n - passed, node.most - depth) < need:
                continue
            run = node.run
            at = np.searchsorted(q[passed:], run)
            left = q[passed:]
            overlap += int(np.count_nonzero(left[np.minimum(at, len(left) - 1)] == run)) if len(left) else 0
            depth += len(run)
            passed += int(np.searchsorted(left, run[-1], side="right"))
            if node.ends and overlap * (num + den) >= num * (n + depth):
                yield from node.ends if wanted is None else wanted.intersection(node.ends)
            stack.extend((kid, depth, overlap, passed) for kid in below(node))


class Sketches:
    """The parity sketches of a cell's sets: which of them a set may link with."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(h) for h in sets], np.int64)
        self.own = [parity_sketch(h) for h in sets]
        width = np.array([len(x) for x in self.own], np.int64)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in set(width.tolist()):  # sets that link have sketches of one width, or one twice as wide
            at = np.flatnonzero((width == w) | (width == 2 * w))
            self.of[w] = at, np.array([fold(self.own[i], w) for i in at])
        self.width = width

    def near(self, i: int) -> np.ndarray:
        found = []
        for w in (len(self.own[i]), len(self.own[i]) // 2):
            if w not in self.of:
                continue
            at, m = self.of[w]
            n, least = self.sizes[at], self.sizes[i]
            part = (self.den * n >= self.num * least) & (self.num * n <= self.den * least)
            part &= (self.width[at] == w) | (w == len(self.own[i]))
            at, m = at[part], m[part]
            bits = np.bitwise_count(m ^ fold(self.own[i], w)).sum(axis=1, dtype=np.int64)
            found.append(at[(self.den + self.num) * bits <= (self.sizes[at] + least) * (self.den - self.num)])
        return np.concatenate(found)


def _cell_links(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between the cell's stored sets (role 0 and 2) and its queries (role 1 and 2) of other components."""
    nodes, labels, roles = group["node"].to_numpy(), group["label"].to_numpy(), group["role"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
    trie, sketches = SetTrie(np.zeros(0, np.uint64), num, den), Sketches(sets, num, den)
    joined = {int(x): int(x) for x in np.unique(labels)}

    def root(x: int) -> int:
        while joined[x] != x:
            joined[x] = x = joined[joined[x]]
        return x

    component = lambda i: root(int(labels[i]))
    stored = np.zeros(len(sets), bool)
    for i in np.flatnonzero(roles == 0):
        trie.add(sets[i], int(i), component)
        stored[i] = True
    out = []
    for i in np.flatnonzero(roles != 0):
        own = lambda i=i: component(i)
        near = sketches.near(int(i))
        near = [j for j in near[stored[near]].tolist() if component(j) != own()]
        for j in trie.search(sets[i], component, own, near) if near else ():
            a, b = component(i), component(j)
            if a != b:
                joined[a] = b
                out.append((nodes[i], nodes[j]))
        if roles[i] == 2:
            trie.add(sets[i], int(i), component)
            stored[i] = True
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _links(cells: DataFrame, num: int, den: int) -> DataFrame:
    """cells: rows (keys..., node, label, role, set)."""
    keys = [c for c in cells.columns if c not in ("node", "label", "role", "set")]
    return cells.groupBy(*keys).applyInPandas(lambda group: _cell_links(group, num, den), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links: label is the smallest node that links reach.

    Rounds in which each node takes its smallest neighbour as parent, pointer jumps find the roots, and the links
    between roots go on.
    """
    turned = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edge = staged(turned(links), "edges")
    label = edge.select(F.col("a").alias("node")).union(edge.select("b")).distinct().select("node", F.col("node").alias("label"))
    label = staged(label, "labels")
    first = True
    while edge.limit(1).count():
        parent = staged(edge.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "parents")
        while True:
            up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = staged(parent.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "parents")
            moved = parent.where("moved").limit(1).count()
            parent = parent.select("node", "up")
            if not moved:
                break
        root = lambda name: parent.select(F.col("node").alias(name), F.col("up").alias(f"up_{name}"))
        if first:  # every label is its own node yet
            label = label.select("node").join(parent, "node", "left").select("node", F.coalesce("up", "node").alias("label"))
        else:
            label = label.join(root("label"), "label", "left").select("node", F.coalesce("up_label", "label").alias("label"))
        label, first = staged(label, "labels"), False
        edge = edge.join(root("a"), "a").join(root("b"), "b", "left").select(F.col("up_a").alias("a"), F.coalesce("up_b", "b").alias("b"))
        edge = staged(turned(edge), "edges")
    return label


def ngram_jaccard(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, text_hash.

    Documents link when the sets of their shingles of so many words have a Jaccard similarity of num / den or more.

    Null or empty texts have an empty set and are a component of their own. Copies collapse to one set before
    anything is compared. A row without doc_id takes part in nothing and has a null component_id. Rows that share
    a doc_id each keep their row; equal texts share a component. Other columns of the input are not read.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = docs.select("doc_id", "text", text_hash()).mapInArrow(_profile(words), "doc_id long, text_hash long, n_shingles long, digest binary, node long, sketch binary")
    profile = staged(profile, "profile")
    real = profile.where("n_shingles > 0 and doc_id is not null")
    classes = staged(real.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("node").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    elements = real.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    routes = docs.where("doc_id is not null").select("text").mapInArrow(_routes(words, num, den, max(1, -(-elements // ROUTE))), _ROUTE)
    met = routes.groupBy("bucket").applyInArrow(_meet, "key long, node long")
    blocks = staged(met.groupBy("key", "node").agg(F.lit(1).alias("one")).select("key", "node"), "met")
    if blocks.limit(1).count():
        links = _verified(docs, classes, blocks, words, num, den)
    else:
        links = None
    out = profile.select("doc_id", "n_shingles", "digest", "text_hash")
    if links is None:
        group = classes.select("digest", F.col("doc_id").alias("component_id"))
    else:
        label = components(links)
        named = classes.join(label, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
        smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        group = named.join(smallest, "label").select("digest", "component_id")
    out = out.join(group, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash")


def _verified(docs: DataFrame, classes: DataFrame, blocks: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes, enough of them to connect all that link. blocks: (key, node)."""
    size = blocks.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
    size = size.groupBy("c", "mark").agg(F.min("key").alias("key"))  # blocks with the same members are one
    blocks = staged(blocks.join(size.select("key", "c"), "key"), "blocks")
    few = blocks.where(F.col("c") <= BLOCK).join(classes.select("node", "n", "sketch"), "node").select("key", "node", "n", "sketch")
    edges = few.repartition("key").sortWithinPartitions("key").mapInArrow(_admitted(num, den), "a long, b long")
    many = blocks.where(F.col("c") > BLOCK)
    pivots = many.groupBy("key").agg(F.min("node").alias("pivot"))
    edges = edges.union(many.join(pivots, "key").where("node <> pivot").select("node", "pivot").distinct())
    group = components(edges)
    nodes = classes.drop("sketch").join(group.withColumnRenamed("label", "group"), "node")
    size = nodes.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    nodes = staged(nodes.join(size, "group").select("node", "doc_id", "n", "group", "sets", "elements"), "nodes")
    texts = docs.where("doc_id is not null")
    texts = sieve(texts, nodes.select("doc_id"), "doc_id").join(nodes, "doc_id")
    # a doc_id that stands in several rows may bring a text of another class
    texts = texts.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "node", "_h"])
    sets = texts.select("text", "node", "n", "group", "sets", "elements")
    sets = staged(sets.mapInArrow(_sets(words), "node long, n long, `group` long, sets long, `elements` long, `set` binary"), "sets")
    small = sets.where(F.col("sets") <= GROUP)
    chunks = F.greatest(F.ceil(F.col("sets") / CELL_SETS), F.ceil(F.col("elements") / CELL_ELEMENTS))
    small = small.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), "chunks"))
    place = lambda j, role: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j"), F.lit(role).alias("role"))
    chunk = F.col("chunk")
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.when(j > chunk, place(j, 0)).when(j == chunk, place(j, 2)).otherwise(place(j, 1)))
    cells = small.withColumn("at", F.explode(places)).select("group", "at.i", "at.j", "node", F.col("node").alias("label"), "at.role", F.col("set"))
    links = staged(_links(cells, num, den), "links")
    large = nodes.where(F.col("sets") > GROUP)
    if not large.limit(1).count():
        return links
    large = blocks.join(large.select("node", "n", "group"), "node").select(F.xxhash64("key", "group").alias("key"), "node", "n")
    large = large.join(large.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c"), "key")
    return staged(links.union(_star(sets.where(F.col("sets") > GROUP).select("node", "n", "set"), staged(large, "large"), num, den)), "links")


def _star(sets: DataFrame, blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links of large groups. blocks: (key, node, pivot, n)."""
    stars = staged(blocks.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pivot"), F.first("n").alias("n")), "stars")
    chunks = stars.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("n") / CELL_ELEMENTS)).alias("m"))
    place = stars.join(chunks, "pivot").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), "m"))
    stored = place.select("pivot", "chunk", "node", F.lit(0).alias("role"))
    asks = chunks.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("chunk"))
    rows = stored.union(asks.select("pivot", "chunk", F.col("pivot").alias("node"), F.lit(1))).withColumn("label", F.col("node"))
    links = staged(_links(rows.join(sets.select("node", "set"), "node"), num, den), "links")
    # blocks that are not one component yet; a pivot that has met all sets of its block is left out there
    label = components(links)
    met = stars.select("node", F.col("pivot").alias("met"))
    member = blocks.join(met, "node", "left").join(label, "node", "left")
    member = member.select("key", "node", "n", F.coalesce("label", "node").alias("label"), (F.col("node") == F.col("pivot")).alias("is_pivot"), (F.coalesce(F.col("met"), F.col("node")) != F.col("pivot")).alias("unmet"))
    member = staged(member, "members")
    others = F.when(~F.col("is_pivot"), F.col("label"))
    state = member.groupBy("key").agg(F.max(F.col("unmet") & ~F.col("is_pivot")).alias("any"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(others).alias("lo_rest"), F.max(others).alias("hi_rest"), F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
    open_ = state.where(F.when(F.col("any"), F.col("lo") != F.col("hi")).otherwise(F.col("lo_rest") != F.col("hi_rest")))
    open_ = open_.groupBy("c", "mark", "any").agg(F.min("key").alias("key")).select("key", "any")  # blocks with the same members are one
    member = staged(member.join(open_, "key").where("any or not is_pivot").select("key", "node", "label", "n"), "open")
    if not member.limit(1).count():
        return links
    member = _grouped(member)
    return links.union(_links(_open_cells(member).join(sets.select("node", "set"), "node"), num, den))


def _grouped(member: DataFrame) -> DataFrame:
    """The rows of open blocks, keyed by the group of overlapping blocks where that is small enough."""
    least = member.groupBy("key").agg(F.min("label").alias("b"))
    edges = member.join(least, "key").select(F.col("label").alias("a"), "b").where("a <> b").distinct()
    group = components(edges).select(F.col("node").alias("label"), F.col("label").alias("group"))
    rows = member.join(group, "label")
    size = rows.select("group", "node").distinct().groupBy("group").agg(F.count("*").alias("size"))
    rows = rows.join(size, "group").withColumn("key", F.when(F.col("size") <= 2 * GROUP, F.col("group")).otherwise(F.col("key")))
    return staged(rows.groupBy("key", "node").agg(F.first("label").alias("label"), F.first("n").alias("n")), "groups")


def _open_cells(member: DataFrame) -> DataFrame:
    """Cells of the blocks with several components: the rest against the largest component, and the rest among itself."""
    parts = member.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    top = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("t"), F.sum("c").alias("all_c"), F.sum("e").alias("all_e"), F.max_by("e", F.struct("c", "label")).alias("te"))
    cells = lambda c, e: F.greatest(F.ceil(c / CELL_SETS), F.ceil(e / CELL_ELEMENTS))
    plan = top.select("key", F.col("t.label").alias("bulk"), cells(F.col("t.c"), F.col("te")).alias("nb"), cells(F.col("all_c") - F.col("t.c"), F.col("all_e") - F.col("te")).alias("nr"))
    rows = member.join(plan, "key").withColumn("side", (F.col("label") != F.col("bulk")).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("side") == 0, F.col("nb")).otherwise(F.col("nr"))))
    cell = lambda kind, i, j, role: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), role.cast("int").alias("role"))
    chunk = F.col("chunk")
    among = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.when(j > chunk, cell("r", chunk, j, F.lit(0))).when(j == chunk, cell("r", chunk, j, F.lit(2))).otherwise(cell("r", j, chunk, F.lit(1))))
    across = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: cell("b", i, chunk, F.lit(1)))
    bulk = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: cell("b", chunk, j, F.lit(0)))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("side") == 0, bulk).otherwise(F.concat(among, across))))
    return rows.select("key", "cell.kind", "cell.i", "cell.j", "node", "label", "cell.role")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'), ' ') AS l,
         text FROM documents),
s AS (
  SELECT doc_id, CASE WHEN text IS NULL OR l = [''] THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
         ELSE list_distinct([l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] FOR i IN range(1, len(l) - 1)]) END AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(u, v) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.v) AS component_id
FROM s JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, len(s.g)
"""
