"""Language ID (operator 4): a linear-chain conditional random field over the words of a text.

A word's features are its character n-grams with word edges (so prefixes and suffixes too) and its entry in a
lexicon learned with the rest; transitions between word labels are learned from runs of words, some of which
switch language midway. Forward-backward gives each word's label probabilities. `label_words` returns the stretches
of a text by language; a document gets the language with the largest mean, and that mean as its score. All features
are counted with whole-array operations.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from boxloom.llm.common import mix, small_batches, table

_U = np.uint64
#: Bounds of the training sample: documents, and characters of a document that may be in it.
TRAIN_DOCS, TRAIN_CHARS = 800, 50_000
#: Feature table size, words of the lexicon, words of a chain, passes and step of AdaGrad, share of switched runs.
BUCKETS, LEXICON, RUN, PASSES, STEP, SWITCHED = 1 << 16, 20_000, 128, 20, 0.25, 0.5
#: Characters that are scored at a time; letters times labels of a block in training.
BLOCK, FIT_CELLS = 1_000_000, 1 << 20
UNKNOWN = "und"
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _alpha[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For a text's words: first letter of each, n-gram buckets of each letter, a hash of each word. None without letters.

    The grams at a letter: it with both neighbours, with the next, and with two before and the next. Whatever is
    not a letter counts as 0, so grams at a word's ends are its affixes.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    spot = np.flatnonzero(is_letter)
    if not len(spot):
        return None
    c = np.zeros(len(codes) + 3, np.uint64)
    c[2:-1] = np.where(is_letter, codes, 0)
    at = spot + 2
    mid, left, right = c[at], c[at - 1], c[at + 1]
    far = np.where(left == 0, _U(0), c[at - 2])
    start = np.flatnonzero(left == 0)
    tri = mix((left << _U(42)) ^ (mid << _U(21)) ^ right)
    grams = np.stack((tri, mix((mid << _U(21)) ^ right ^ _U(1 << 63)), mix(tri ^ (far * _U(0x9E3779B97F4A7C15)) ^ _U(7))))
    grams = (grams >> _U(48)).astype(np.int32) & (BUCKETS - 1)
    # a position-weighted sum of a word's letters
    place = np.arange(len(spot)) - np.repeat(start, np.diff(np.append(start, len(spot))))
    word = mix(np.add.reduceat(mix(mid + (place.astype(np.uint64) << _U(24))), start))
    return start, grams, word


def runs(doc_of_word: np.ndarray) -> np.ndarray:
    """Word indices by chain, -1 past the end; a chain has up to RUN words of one document."""
    n = len(doc_of_word)
    first = np.flatnonzero(np.diff(doc_of_word, prepend=-1))
    size = np.diff(np.append(first, n))
    pos = np.arange(n) - np.repeat(first, size)
    chains = -(-size // RUN)
    row = np.repeat(np.cumsum(chains) - chains, size) + pos // RUN
    out = np.full((int(chains.sum()), RUN), -1, np.int64)
    out[row, pos % RUN] = np.arange(n)
    return out


def forward_backward(emit: np.ndarray, chain: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and the expected number of each transition."""
    k = emit.shape[1]
    there = chain >= 0
    e = np.where(there[..., None], emit[np.maximum(chain, 0)], 0.0)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(move - move.max())
    fore = np.empty_like(e)
    fore[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, chain.shape[1]):
        x = (fore[:, i - 1] @ t) * e[:, i]
        fore[:, i] = x / x.sum(axis=1, keepdims=True)
    back = np.ones_like(e)
    moved = np.zeros((k, k))
    for i in range(chain.shape[1] - 2, -1, -1):
        on = there[:, i + 1, None]
        y = e[:, i + 1] * back[:, i + 1]
        pair = (fore[:, i].T @ (np.where(on, y / np.maximum((fore[:, i] @ t * y).sum(axis=1, keepdims=True), 1e-300), 0.0))) * t
        moved += pair
        x = y @ t.T
        back[:, i] = np.where(on, x / x.sum(axis=1, keepdims=True), 1.0)
    p = fore * back
    p /= p.sum(axis=2, keepdims=True)
    out = np.zeros_like(emit)
    out[chain[there]] = p[there]
    return out, moved


class Crf:
    """Weights: n-gram buckets, lexicon words, transitions. labels: the languages, by code point."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.gram = np.zeros((BUCKETS, k), np.float32)
        self.word = np.zeros((len(lexicon) + 1, k), np.float32)  # the last row: not in the lexicon
        self.move = np.zeros((k, k))

    def look_up(self, words: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, words), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == words, at, len(self.lexicon))

    def emissions(self, start: np.ndarray, grams: np.ndarray, entry: np.ndarray) -> np.ndarray:
        letters = self.gram[grams[0]]
        for g in grams[1:]:
            letters += self.gram[g]
        size = np.diff(np.append(start, grams.shape[1])).astype(np.float32)
        return np.add.reduceat(letters, start, axis=0) / np.sqrt(size)[:, None] + self.word[entry]

    def posteriors(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts by their features: which text each word is of, and the word's label probabilities."""
        shift = np.cumsum([0] + [f[1].shape[1] for f in found])
        owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        start = np.concatenate([f[0] + s for f, s in zip(found, shift, strict=False)])
        emit = self.emissions(start, np.concatenate([f[1] for f in found], axis=1), self.look_up(np.concatenate([f[2] for f in found])))
        return owner, forward_backward(emit, runs(owner), self.move)[0]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: (und, 0.0) without letters, or if nothing was learned. Ties go to the first label."""
        if not self.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        sums, count = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        block, held = [], 0

        def score() -> None:
            nonlocal block, held
            if not block:
                return
            owner, p = self.posteriors([f for _, f in block])
            doc = np.array([i for i, _ in block])[owner]
            for j in range(len(self.labels)):
                sums[:, j] += np.bincount(doc, weights=p[:, j], minlength=len(texts))
            count[:] += np.bincount(doc, minlength=len(texts))
            block, held = [], 0

        for i, text in enumerate(texts):
            for part in pieces(text or ""):
                found = features(part)
                if found is not None:
                    block.append((i, found))
                    held += len(part)
                    if held >= BLOCK:
                        score()
        score()
        best = sums.argmax(axis=1)
        return [(self.labels[b], min(1.0, float(sums[i, b] / count[i]))) if count[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]

    def stretches(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(begin, end, language, mean probability, words) of each longest run of words with one language, in order.

        begin and end count characters of the text: from a run's first letter to past its last.
        """
        out: list[tuple[int, int, str, float, int]] = []
        at = 0
        for part in pieces(text or "") if self.labels else ():
            found = features(part)
            if found is not None:
                p = self.posteriors([found])[1]
                best = p.argmax(axis=1)
                begin, end = word_places(part, found[0])
                first = np.flatnonzero(np.diff(best, prepend=-1))
                for i, j in zip(first, np.append(first[1:], len(best)), strict=True):
                    stretch = (at + int(begin[i]), at + int(end[j - 1]), self.labels[best[i]], float(p[i:j, best[i]].mean()), int(j - i))
                    if out and i == 0 and out[-1][2] == stretch[2]:  # goes on from the part before
                        b, _, lang, mean, n = out.pop()
                        stretch = (b, stretch[1], lang, (mean * n + stretch[3] * stretch[4]) / (n + stretch[4]), n + stretch[4])
                    out.append(stretch)
            at += len(part)
        return out


def word_places(text: str, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of features(text) begin and end in it; a letter may have several in lower case."""
    lower = text.lower()
    spot = np.flatnonzero(_letters()[np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)])
    if len(lower) != len(text):
        spot = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])[spot]
    return spot[start], spot[np.append(start[1:], len(spot)) - 1] + 1


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK characters, cut between words (a longer run of letters is cut where it must be)."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and end < at + 2 * BLOCK and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Crf:
    """Trains on (text, language) rows; forward-backward over all their words in each pass.

    Each pass goes through all chains by blocks. The n-gram buckets of the letters lie in a temporary file that is mapped,
    so that memory has one block's letters and a few numbers a word, not the whole sample's letters.
    """
    labels = sorted({lang for _, lang in rows})
    k = len(labels)
    with tempfile.TemporaryFile() as file:
        starts, hashes, said, letters = [], [], [], 0
        for text, lang in rows:
            found = features(text)
            if found is not None:
                file.write(found[1].T.astype(np.uint16).tobytes())  # BUCKETS are no more than it holds
                starts.append(found[0] + letters)
                hashes.append(found[2])
                said.append(labels.index(lang))
                letters += found[1].shape[1]
        if not said:
            return Crf([], np.zeros(0, np.uint64))
        file.flush()
        grams = np.memmap(file, np.uint16, "r").reshape(-1, 3)
        size = np.array([len(h) for h in hashes])
        words = np.concatenate(hashes)
        del hashes
        names, counts = np.unique(words, return_counts=True)
        often = counts >= 3
        names, counts = names[often], counts[often]
        crf = Crf(labels, np.sort(names[np.argsort(-counts, kind="stable")[:LEXICON]]))
        n = len(words)
        entry = np.empty(n, np.int32)
        for i in range(0, n, BLOCK):
            entry[i : i + BLOCK] = crf.look_up(words[i : i + BLOCK])
        del words
        start = np.concatenate([*starts, [letters]])
        del starts
        chain = _halves(size, np.array(said))
        # code switching: the second halves of some chains change places
        rng = np.random.default_rng(seed)
        pick = rng.permutation(len(chain))[: int(len(chain) * SWITCHED)]
        chain[pick, 1] = chain[rng.permutation(pick), 1]
        blocks = _blocks(chain, start, max(BUCKETS, FIT_CELLS // k))
        past = [np.full_like(x, 1e-6, dtype=np.float64) for x in (crf.gram, crf.word, crf.move)]
        for _ in range(PASSES):
            steps = [np.zeros(x.shape, order="F") for x in past]
            for block in blocks:
                _add_gradient(crf, block, grams, start, entry, steps)
            for weight, g, h in zip((crf.gram, crf.word, crf.move), steps, past, strict=True):
                g /= n
                h += g * g
                weight += (STEP * g / np.sqrt(h + 1e-12)).astype(weight.dtype)
        return crf


def _halves(size: np.ndarray, label: np.ndarray) -> np.ndarray:
    """First word, number of words and label of both halves of each chain that runs() makes of documents of so many words."""
    chains = -(-size // RUN)
    doc = np.repeat(np.arange(len(size)), chains)
    at = (np.arange(len(doc)) - (np.cumsum(chains) - chains)[doc])[:, None] * RUN + [0, RUN // 2]
    words = np.clip(size[doc][:, None] - at, 0, RUN // 2)
    return np.stack((np.where(words > 0, (np.cumsum(size) - size)[doc][:, None] + at, 0), words, np.broadcast_to(label[doc][:, None], at.shape)), axis=2)


def _blocks(chain: np.ndarray, start: np.ndarray, most: int) -> list[np.ndarray]:
    """All chains in order, in blocks whose words have about `most` letters; start: first letter of each word, and the number of letters."""
    size = (start[chain[..., 0] + chain[..., 1]] - start[chain[..., 0]]).sum(axis=1)
    return np.split(chain, np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1)


def _add_gradient(crf: Crf, block: np.ndarray, grams: np.ndarray, start: np.ndarray, entry: np.ndarray, steps: list[np.ndarray]) -> None:
    """Adds what a block of chains wants changed, summed over its words, to the steps of the three weights."""
    there = np.arange(RUN // 2) < block[..., 1, None]
    at = (block[..., 0, None] + np.arange(RUN // 2))[there]
    label = np.repeat(block[..., 2].reshape(-1), block[..., 1].reshape(-1))
    there = there.reshape(-1, RUN)
    chain = np.full(there.shape, -1)
    chain[there] = np.arange(len(at))
    wide, entry = start[at + 1] - start[at], entry[at]
    first = np.cumsum(wide) - wide
    word = np.repeat(np.arange(len(at)), wide)
    found = grams[np.arange(len(word)) + (start[at] - first)[word]].T.astype(np.int32, order="C")
    p, moved = forward_backward(crf.emissions(first, found, entry).astype(np.float64), chain, crf.move)
    gap = np.negative(p, out=p)
    gap[np.arange(len(at)), label] += 1
    flat, scale = found.reshape(-1).astype(np.intp), 1 / np.sqrt(wide)
    for j in range(len(crf.labels)):
        steps[0][:, j] += np.bincount(flat, weights=np.tile((gap[:, j] * scale)[word], 3), minlength=BUCKETS)
        steps[1][:, j] += np.bincount(entry, weights=gap[:, j], minlength=len(crf.word))
    y, both = label[np.maximum(chain, 0)], there[:, 1:] & there[:, :-1]
    k = len(crf.labels)
    steps[2] += np.bincount(y[:, :-1][both] * k + y[:, 1:][both], minlength=k * k).reshape(k, k) - moved


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Crf:
    """Fits on at most `limit` labelled documents outside the held-out fifth, chosen by a hash of doc_id.

    Texts of over TRAIN_CHARS characters are not in the sample, so that its size is bounded.
    """
    sample = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    sample = sample.select("text", "lang", F.xxhash64("doc_id", F.lit(23)).alias("h"))
    # the hashes decide first, so that no task sends more texts than the sample has
    cut = sample.select("h").orderBy("h").limit(limit).agg(F.max("h").alias("h")).first()["h"]
    if cut is None:
        return fit([])
    rows = sample.where(F.col("h") <= cut).orderBy("h", "lang", F.xxhash64("text")).limit(limit).collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def held_out():
    """crc32 of doc_id as text, modulo 5, is 0. Rows without doc_id count as held out: they are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _with(docs: DataFrame, names: tuple[str, ...], kinds: str, of) -> DataFrame:
    """docs with columns from of(texts), one tuple a text; columns of those names are replaced."""
    docs = small_batches(docs).drop(*names)
    at = docs.columns.index("text")
    added = StructType.fromDDL(kinds)
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = list(zip(*of(part.column(at).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, f.type) for x, f in zip(found, arrow, strict=True))], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """All rows and columns of docs, with lang_pred and score (columns of those names are replaced).

    Null texts and texts without letters get und and 0.0; so do all if nothing was learned. Very long texts are read
    in parts, whole. Languages that tie go by code point. Repeated rows each keep theirs; an empty table gives none.
    """
    return _with(docs, ("lang_pred", "score"), "lang_pred string, score double", crf.label)


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """All rows and columns of docs, with stretches: the runs of words in one language, for texts that switch.

    Each has begin and end (characters of the text), lang, score (mean probability of its words) and words (their
    number). Texts that are null or have no letters have none; a column of that name is replaced.
    """
    kind = "stretches array<struct<begin: long, end: long, lang: string, score: double, words: long>>"
    keys = ("begin", "end", "lang", "score", "words")
    return _with(docs, ("stretches",), kind, lambda texts: [([dict(zip(keys, x, strict=True)) for x in crf.stretches(t)],) for t in texts])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
