"""Packing (operator 9): lexical retrieval packing.

Document frequencies and the mean length are counted over the whole table. Each document gets a key: its first terms
in a weighted min-hash order (weights are BM25's), so two documents agree in the key's first term with a probability
that is the similarity of their weights. The table is sorted by that key, over all tasks, so lexically related
documents meet wherever they were read; one key's rows may spread over several tasks. A task reads its range in shards
of bounded size and builds a BM25 index over a shard's token ids, with the table's statistics. A seed document opens a
window; the index returns its unused neighbours, best first, and they fill the window. A neighbour that does not fit
is cut, and its rest opens the next window as the next seed. Neighbours beyond the shard are not found.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import mix, small_batches, staged, table

WINDOW, END = 2048, 1
#: A shard ends at so many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 1024, 2_000_000
K1, B = 1.2, 0.75
#: Terms of a document's key, and tokens of a range of the sorted table.
KEY_TERMS, RANGE_TOKENS = 4, 1_000_000
#: Cells of a shard's matrix, four bytes each, up to which the packer fills it in.
DENSE_CELLS = 1 << 24
_SPACE, _LONG = re.compile(r"\s"), re.compile(r"\S{3000}")
#: Runs of what the vocabulary's pattern takes as white space, which is less than Python's by U+001C to U+001F.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _long(text: str) -> bool:
    """Whether _LONG is in the text: such a run covers a whole block of half its length, so blocks with a space early say no at once."""
    return any(not _SPACE.search(text, i, i + 1500) for i in range(0, len(text) - 1499, 1500)) and bool(_LONG.search(text))


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids. The vocabulary's rank file beside the .json gives the same ids faster; both are tested equal.

    Texts with a run of 3000 characters or more without white space go to the .json file's own library, whose
    merge is not quadratic in such runs.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full: list = []

    def plain(text: str) -> list[int]:
        if not full:
            full.append(Tokenizer.from_file(path))
            full[0].encode_special_tokens = True
        return full[0].encode(text, add_special_tokens=False).ids

    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # searches are slow with the pattern's look ahead, which only parts the last of a run of spaces from the others: texts are cut there instead
    rest = public_tokenizers.PATTERN.removesuffix(r"|\s+(?!\S)|\s+")
    if rest == public_tokenizers.PATTERN:
        raise ValueError(f"not the pattern of white space that is known: {rest}")
    fast = tiktoken.Encoding("ranks", pat_str=rest + r"|\s+", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _long(text):
            return plain(text)
        cuts = [end - 1 for m in _RUN.finditer(text) if (end := m.end()) < len(text)]
        if not cuts:
            return fast.encode_ordinary(text)
        return [x for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) for x in fast.encode_ordinary(text[a:b])]

    return encode


@dataclass(frozen=True)
class Statistics:
    """What BM25 asks of a collection of documents."""

    df: np.ndarray  # documents that hold each term
    docs: int
    tokens: int

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length * self.docs / self.tokens))

    @cached_property
    def draws(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each term, and an exponential draw by it over the term's idf."""
        drawn = mix(np.arange(len(self.df), dtype=np.uint64) + np.uint64(1))
        return drawn.view(np.int64), -np.log((drawn.astype(np.float64) + 1) / 2.0**64) / self.idf

    def key(self, ids: np.ndarray) -> list[int]:
        """A document's first terms in an order by exponential draws, one a term, over the term's weight in it."""
        drawn, draw = self.draws
        term, tf = np.unique(ids, return_counts=True)
        at = draw[term] * (tf + K1 * (1 - B + B * len(ids) * self.docs / self.tokens)) / tf
        first = np.argsort(at, kind="stable")[:KEY_TERMS]
        return [*drawn[term[first]].tolist(), *[0] * (KEY_TERMS - len(first))]


class Bm25:
    """An index over the token ids of a shard: a sparse matrix of weights, a row a document. All terms are in it.

    For neighbours it is also filled in, a row a term, up to DENSE_CELLS: a sum of whole rows takes less than half the
    time of a look at each posting. Above that the postings are read.
    """

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None):
        bags = [np.unique(d, return_counts=True) for d in docs]
        length = np.array([len(d) for d in docs], np.float64)
        size = np.array([len(t) for t, _ in bags], np.int64)
        term = np.concatenate([t for t, _ in bags]).astype(np.int64)
        if statistics is None:
            statistics = Statistics(np.bincount(term), len(docs), int(length.sum()))
        self.weight = statistics.weight(term, np.concatenate([c for _, c in bags]).astype(np.float64), np.repeat(length, size))
        self.begin = np.concatenate(([0], np.cumsum(size)))
        known = np.flatnonzero(np.bincount(term))
        spot = np.zeros(known[-1] + 1 if len(known) else 0, np.int64)
        spot[known] = np.arange(len(known))
        self.term, self.asked, self.known = spot[term], np.zeros(len(known)), known
        self.size, self.rows, self.start, self.column = size, np.arange(len(docs)), self.begin[:-1], self.term
        self.dense: np.ndarray | None = None
        self._keep(size > 0)

    def _keep(self, of: np.ndarray) -> None:
        """Leaves the matrix with those of its rows."""
        if self.dense is not None:
            self.rows, self.dense = self.rows[of], np.compress(of, self.dense, axis=1)
            return
        cell = np.repeat(of, self.size[self.rows])
        self.rows, self.column, self.weight = self.rows[of], self.column[cell], self.weight[cell]
        self.start = np.concatenate(([0], np.cumsum(self.size[self.rows])))[:-1]

    def _fill(self) -> None:
        if self.dense is None and len(self.known) * len(self.rows) <= DENSE_CELLS:
            self.dense = np.zeros((len(self.known), len(self.rows)), np.float32)
            self.dense[self.column, np.repeat(np.arange(len(self.rows)), self.size[self.rows])] = self.weight
            self.column = self.weight = self.start = None

    def _sums(self, spot: np.ndarray) -> np.ndarray:
        """The score of each row for a query of terms, by their place in `known`."""
        if self.dense is not None:
            return self.dense[spot].sum(axis=0)
        self.asked[spot] = 1.0
        out = np.add.reduceat(self.weight * self.asked[self.column], self.start) if len(self.rows) else np.zeros(0)
        self.asked[spot] = 0.0
        return out

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The score of each document for a query of distinct terms."""
        spot = np.searchsorted(self.known, terms)
        inside = spot < len(self.known)
        spot = spot[inside][self.known[spot[inside]] == terms[inside]]
        out = np.zeros(len(self.size))
        out[self.rows] = self._sums(spot)
        return out

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with doc, by descending score, ties to the earlier one.

        A document that is used once stays so: the matrix forgets such rows when they are half of it.
        """
        self._fill()
        if 2 * np.count_nonzero(unused[self.rows]) < len(self.rows):
            self._keep(unused[self.rows])
        if not len(self.rows):
            return np.zeros(0, np.int64)
        score = self._sums(self.term[self.begin[doc] : self.begin[doc + 1]])
        found = (score > 0) & unused[self.rows]
        score, found = score[found], self.rows[found]
        return found[np.argsort(-score, kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (doc, start, length, sequence, offset) of a shard; all sequences but the last are full."""
    index, unused = Bm25(docs, statistics), np.ones(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, filled, first = 0, 0, 0

    def place(doc: int) -> bool:
        """Puts a whole document; true if it reached into a new window."""
        nonlocal sequence, filled
        unused[doc] = False
        start, size, crossed = 0, len(docs[doc]), False
        while start < size:
            if filled == window:
                sequence, filled, crossed = sequence + 1, 0, True
            n = min(window - filled, size - start)
            out.append((doc, start, n, sequence, filled))
            start, filled = start + n, filled + n
        return crossed

    while first < len(docs):
        if not unused[first]:
            first += 1
            continue
        seed = first
        place(seed)
        while seed is not None and filled < window:
            following = None
            for near in index.neighbours(seed, unused):
                if filled == window:
                    break
                if place(int(near)):
                    following = int(near)  # its rest opened a window
                    break
            seed = following
    return out


def _stored(ids: np.ndarray) -> bytes:
    return (ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids).tobytes()


def _read(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n else np.uint16).astype(np.int32, copy=False)


def _encode(path: str):
    """Rows (row, doc_id, n, ids) of documents, ids in two bytes each where they fit; each task ends with a row without row that holds its document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row, df = encoder(path), TaskContext.get().partitionId() << 40, np.zeros(0, np.int64)
        names = ["row", "doc_id", "n", "ids"]
        for batch in batches:
            docs = []
            for x in batch.column(1):
                found = encode(x.as_py() or "")
                found.append(END)
                docs.append(np.frombuffer(array("i", found), np.int32))
            if not docs:
                continue
            more = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(df))
            more[: len(df)] += df
            df = more
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(docs))), batch.column(0), pa.array([len(d) for d in docs], pa.int64()), pa.array([_stored(d) for d in docs], pa.binary())], names=names)
            row += len(docs)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=names)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            df = np.frombuffer(x.as_py(), np.int64)
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())], names=["term", "df"])


def collect_statistics(encoded: DataFrame) -> Statistics:
    """One row a term of the tokenizer's vocabulary comes to the driver."""
    total = encoded.where("row is not null").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    counts = encoded.where("row is null").select("ids").mapInArrow(_frequencies, "term long, df long")
    counts = counts.groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(counts["term"].max()) + 1 if len(counts) else 1, np.int64)
    df[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    return Statistics(df, total["docs"], total["tokens"])


def _keys(statistics: Statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [statistics.key(_read(x.as_py(), n)) for x, n in zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True)]
            columns = [pa.array(list(x), pa.int64()) for x in zip(*keys, strict=True)] or [pa.array([], pa.int64())] * KEY_TERMS
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=[*(f"key{i}" for i in range(KEY_TERMS)), *batch.schema.names])

    return run


def _pack(window: int, statistics: Statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        ids: list = []
        docs: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, tokens, done
            pieces = pack_shard(docs, window, statistics)
            crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            size = np.array([len(x) for x in docs], np.int64)
            out = [pa.array([ids[d] for d in doc], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64), size[doc], sequence + (task << 40) + done, offset))]
            done += int(sequence[-1]) + 1
            ids, docs, tokens = [], [], 0
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for key, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(key)
                docs.append(_read(found.as_py(), n))
                tokens += n
                if len(docs) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence (SCHEMA).

    A document's ids are those of its text (null: empty) and the end id, so each has at least one piece. Pieces of
    repeated rows and of equal texts are kept apart. Each shard's last sequence may be short: the padding is below
    one window a shard. An empty table gives no pieces. Where ranges and shards of the sorted table end, and so the
    sequences, may differ between runs. Other columns are not read.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = staged(docs.mapInArrow(_encode(tokenizer or default_tokenizer()), "row long, doc_id long, n long, ids binary"), "tokens", "zstd")
    statistics = collect_statistics(encoded)
    order = [f"key{i}" for i in range(KEY_TERMS)] + ["row"]
    keyed = encoded.where("row is not null").mapInArrow(_keys(statistics), ", ".join(f"key{i} long" for i in range(KEY_TERMS)) + ", row long, doc_id long, n long, ids binary")
    ranges = max(1, -(-statistics.tokens // RANGE_TOKENS))
    keyed = staged(keyed, "keyed", "zstd").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return keyed.select("doc_id", "n", "ids").mapInArrow(_pack(window, statistics), SCHEMA)


def search(docs: DataFrame, every: int = 100, k: int = 10, tokenizer: str | None = None) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best BM25 neighbours in the whole table of each row whose id is divisible by `every`.

    Every block of queries meets every shard of the index in one task, and the shards' best are merged, so no neighbour is
    missed. Queries are the distinct tokens of their row's text. Rows with the query's id are none of its neighbours,
    nor are those that share no token; ties go to the smaller id. Rows without id take no part. What this finds for a
    stated set of queries the packer can't ask for each of its seeds: see there.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    encoded = staged(docs.mapInArrow(_encode(tokenizer or default_tokenizer()), "row long, doc_id long, n long, ids binary"), "tokens", "zstd")
    statistics = collect_statistics(encoded)
    rows = encoded.where("row is not null").drop("row")
    spread = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(n)).cast("int"))
    asks = rows.where(F.col("doc_id") % every == 0)
    shards, parts = max(1, -(-statistics.tokens // SHARD_TOKENS)), max(1, -(-asks.count() // SHARD_DOCS))
    key = ["part", "shard"]
    right = spread(rows, "shard", shards).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    left = spread(asks, "part", parts).select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard):
            index, ids = Bm25([_read(x, n) for x, n in zip(shard["ids"], shard["n"], strict=True)], statistics), shard["doc_id"].to_numpy()
            for query, raw, n in zip(queries["doc_id"], queries["ids"], queries["n"], strict=True):
                score = np.round(index.scores(np.unique(_read(raw, n))), 9)
                score[ids == query] = 0.0
                best = np.lexsort((ids, -score))[:k]
                out += [(query, ids[i], score[i]) for i in best if score[i] > 0]
        return pd.DataFrame(out, columns=["query_id", "doc_id", "score"])

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op9_retrieval_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
