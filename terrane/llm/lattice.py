"""Log probabilities of texts, summed over all ways to cut their words into the pieces of a public vocabulary.

A text is its words, each led by a blank, and one end. A unigram model draws pieces one after another; a text's probability is
the sum over all piece sequences that spell it. Pieces cross no word, so it is a product of words, and a word's sum
comes from a forward recursion in log space over the pieces that an automaton finds in it. Single bytes are pieces too, so
every word has a cut. The vocabulary comes with scores (minus the rank of a piece); read as Zipf's law they
weight all cuts of the training words, and the expected counts of the pieces make the model's probabilities, with the
vocabulary's own as prior.

Everything is done once per distinct word of the corpus: words are counted per task, then in Spark; recursions run
over that table. The most frequent words (at most ``HEAD``, 20 bytes each and their sums) are sent to the tasks, all
others meet their documents in a join, where none of them can be more than a part in ``HEAD`` of all tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import table
from terrane.session import Stored

HEAD = 1 << 20       # words with at least this part of all tokens are sent to the tasks
HELD = 300_000       # distinct words that a task counts before it hands them on
BLOCK = 1 << 22      # bytes of a text that are split into words at a time
LETTERS = 1 << 18    # bytes of words whose cuts are summed together
GRAIN = 1 << 16      # expected counts are whole numbers of this part, so sums do not depend on the split
END = b""            # stands for the end of a text; no word is empty
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
LN10 = math.log(10)


def words(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the words of a text, A-Z in lower case; a long text gives several."""
    data = (text or "").encode().lower()  # of bytes, this changes A-Z only
    at = 0
    while len(data) - at > BLOCK:
        cut = _BLANK.search(data, at + BLOCK)
        if not cut:
            break
        yield data[at:cut.start()].split()
        at = cut.end()
    yield data[at:].split()


def counted(text: str | None) -> Counter:
    """How often each word occurs, and one end."""
    counts = Counter()
    for part in words(text):
        counts.update(part)
    counts[END] = 1
    return counts


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in lower case (a blank leads those that begin a word), log weights of the scores, and the place of byte 0."""

    pieces: list[str]
    weights: np.ndarray      # natural logs, of pieces, then 256 bytes, then the end; they sum to one

    @property
    def bytes_at(self) -> int:
        return len(self.pieces)

    @property
    def end_at(self) -> int:
        return len(self.pieces) + 256


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece file that words in lower case can hold, weighted by one over their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or re.search(r"[A-Z]|.\s|^\s\s", piece, re.S):
            continue
        pieces.append(piece)
        ranks.append(1.0 - model.get_score(i))
    last = max(ranks, default=1.0)
    # a byte ranks after all pieces, the end as one text in a hundred words
    weights = np.array([1.0 / r for r in ranks] + [1.0 / (last + 1)] * 256)
    weights = np.append(weights, weights.sum() / 100)
    return Vocabulary(pieces, np.log(weights / weights.sum()))


@dataclass
class _Arcs:
    """Pieces found in a batch of words. Words lie one after another, each with a node before, between and after its letters."""

    source: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    level: np.ndarray      # place of the target in its word, from 1
    piece: np.ndarray      # of the vocabulary; or minus one minus the place in ``letters``, for the bytes of a letter
    letters: list[str]
    first: np.ndarray      # node before each word
    last: np.ndarray       # and after it


class Lattice:
    """All cuts of words, under log weights in the order of a vocabulary."""

    def __init__(self, known: Vocabulary, weights: np.ndarray):
        import ahocorasick

        self.known, self.weights = known, np.asarray(weights, np.float64)
        self.lengths = np.array([len(p) for p in known.pieces], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, piece in enumerate(known.pieces):
            self.automaton.add_word(piece, i)
        if known.pieces:
            self.automaton.make_automaton()

    def _bytes(self, letter: str) -> list[int]:
        return [self.known.bytes_at + b for b in letter.encode()]

    def _arcs(self, words: list[bytes]) -> _Arcs:
        # no piece has a blank but in front, so none crosses from one word to the next
        text = "".join([" " + w.decode() for w in words])
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        begins = points == 0x20
        number = np.cumsum(begins) - 1
        start = np.flatnonzero(begins)
        at = np.arange(len(text))
        node, place = at + number, at - start[number]     # left of each letter
        letters, letter = np.unique(points, return_inverse=True)
        letters = [chr(c) for c in letters]
        spelled = np.array([self.weights[self._bytes(c)].sum() for c in letters])
        found = np.array(list(self.automaton.iter(text)) if self.known.pieces else [], np.int64).reshape(-1, 2)
        end, piece = found[:, 0], found[:, 1]
        source = np.concatenate([node, node[end] + 1 - self.lengths[piece]])
        target = np.concatenate([node, node[end]]) + 1
        level = np.concatenate([place, place[end]]) + 1
        weight = np.concatenate([spelled[letter], self.weights[piece]])
        last = np.append(start[1:], len(text)) + np.arange(len(start))
        return _Arcs(source, target, weight, level, np.concatenate([-1 - letter, piece]), letters, start + np.arange(len(start)), last)

    @staticmethod
    def _recursion(known: np.ndarray, level: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log sums at the targets, level by level; what a level reads is finished when it begins."""
        order = np.lexsort((target, level))
        level, source, target, weight = level[order], source[order], target[order], weight[order]
        cuts = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(level)]
        for s, e in zip(cuts, cuts[1:]):
            terms, to = known[source[s:e]] + weight[s:e], target[s:e]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(terms, heads)
            shares = np.exp(terms - np.repeat(top, np.diff(np.append(heads, len(to)))))
            known[to[heads]] = top + np.log(np.add.reduceat(shares, heads))
        return known

    def _forward(self, arcs: _Arcs) -> np.ndarray:
        a = np.full(int(arcs.last[-1]) + 1, -np.inf)
        a[arcs.first] = 0.0
        return self._recursion(a, arcs.level, arcs.source, arcs.target, arcs.weight)

    def _backward(self, arcs: _Arcs) -> np.ndarray:
        b = np.full(int(arcs.last[-1]) + 1, -np.inf)
        b[arcs.last] = 0.0
        return self._recursion(b, -(arcs.level - (arcs.target - arcs.source)), arcs.target, arcs.source, arcs.weight)

    @staticmethod
    def _blocks(words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Ranges of words with at most LETTERS bytes together, or a single longer one."""
        first, size = 0, 0
        for k, w in enumerate(words):
            if k > first and size + len(w) > LETTERS:
                yield first, k
                first, size = k, 0
            size += len(w) + 1
        if len(words) > first:
            yield first, len(words)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all cuts of each word; the end has its own weight."""
        out = np.full(len(words), self.weights[self.known.end_at])
        at = [k for k, w in enumerate(words) if w != END]
        real = [words[k] for k in at]
        for s, e in self._blocks(real):
            arcs = self._arcs(real[s:e])
            out[at[s:e]] = self._forward(arcs)[arcs.last]
        return out

    def expected(self, words: list[bytes], counts: list[int], grain: int = GRAIN) -> np.ndarray:
        """How often each piece is used in all cuts of the words, in their proportion, times ``grain``, whole numbers."""
        sums = np.zeros(len(self.weights), np.int64)
        sums[self.known.end_at] = grain * sum([c for w, c in zip(words, counts) if w == END])
        kept = [(w, c) for w, c in zip(words, counts) if w != END and c]
        real = [w for w, _ in kept]
        for s, e in self._blocks(real):
            arcs = self._arcs(real[s:e])
            a, b = self._forward(arcs), self._backward(arcs)
            word = np.searchsorted(arcs.first, arcs.source, side="right") - 1
            share = np.exp(a[arcs.source] + arcs.weight + b[arcs.target] - a[arcs.last][word])
            # rounded word by word, so that sums are the same in any order
            used = np.rint(share * np.array([c * grain for _, c in kept[s:e]], np.float64)[word]).astype(np.int64)
            whole = arcs.piece >= 0
            np.add.at(sums, arcs.piece[whole], used[whole])
            spelled = np.zeros(len(arcs.letters), np.int64)
            np.add.at(spelled, -1 - arcs.piece[~whole], used[~whole])
            for letter, n in zip(arcs.letters, spelled.tolist()):
                for i in self._bytes(letter):
                    sums[i] += n
        return sums


def learned(known: Vocabulary, counts: dict[int, float]) -> np.ndarray:
    """Log probabilities from expected counts; the prior weighs as much as one count for each piece."""
    size = len(known.weights)
    total = np.exp(known.weights) * size
    for i, n in counts.items():
        total[i] += n
    return np.log(total / total.sum())


def training() -> Column:
    """Rows that are learned from: crc32 of the id as text, mod 7, is not 2 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learn: Counter = Counter()
    rest: Counter = Counter()

    def out():
        distinct = list(learn.keys() | rest.keys())
        return pa.RecordBatch.from_arrays([
            pa.array(distinct, pa.binary()), pa.array([learn[w] for w in distinct], pa.int64()),
            pa.array([learn[w] + rest[w] for w in distinct], pa.int64())], names=["word", "c", "everywhere"])

    for b in batches:
        for text, train in zip(b.column("text"), b.column("train").to_pylist()):
            (learn if train else rest).update(counted(text.as_py()))
            if len(learn) + len(rest) > HELD:
                yield out()
                learn.clear()
                rest.clear()
    if learn or rest:
        yield out()


def _expected(path: str, weights: np.ndarray):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), weights)
        sums = np.zeros(len(weights), np.int64)
        for b in rows:
            sums += lattice.expected(b.column("word").to_pylist(), b.column("c").to_pylist())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["piece", "n"])
    return batches


def _digests(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each word, as the two numbers by which it is joined."""
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in found]), "<i4").reshape(-1, 4)
    return np.ascontiguousarray(raw[:, :2]).view("<i8").ravel(), raw[:, 2]


def _weighed(path: str, weights: np.ndarray):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), weights)
        for b in rows:
            found = b.column("word").to_pylist()
            w, v = _digests(found)
            yield pa.RecordBatch.from_arrays([
                pa.array(w), pa.array(v), b.column("c"), b.column("everywhere"),
                pa.array(lattice.log_probabilities(found) / LN10)], names=["w", "v", "c", "everywhere", "log_p"])
    return batches


@dataclass(frozen=True)
class Frequent:
    """The words sent to the tasks, sorted by their digests: training count and log10 probability."""

    w: np.ndarray
    v: np.ndarray
    c: np.ndarray
    log_p: np.ndarray

    def places(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The place of each digest here, or -1."""
        if not len(self.w):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        return np.where((self.w[at] == w) & (self.v[at] == v), at, -1)


def _documents(frequent: Frequent):
    """One row a document: its place, what frequent words add, and the digests and counts of the others."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        logs = np.log10(frequent.c + 1.0)
        names = ["part", "no", "doc_id", "train", "n_tokens", "known", "logs", "log_p", "w", "v", "tf"]
        for b in rows:
            ids, train = b.column("doc_id"), b.column("train")
            made, first, held = [], 0, 0
            for k, text in enumerate(b.column("text")):
                counts = counted(text.as_py())
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                w, v = _digests(list(counts))
                at = frequent.places(w, v)
                here, other = at >= 0, at < 0
                at, n = at[here], tf[here]
                made.append((part, no, int(tf.sum()), int(n[frequent.c[at] > 0].sum()), math.fsum(n * logs[at]), math.fsum(n * frequent.log_p[at]),
                             w[other], v[other], tf[other]))
                no, held = no + 1, held + len(w)
                if held > 1 << 20 or k + 1 == b.num_rows:
                    cols = list(zip(*made))
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[6]])]).astype(np.int32))
                    arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in cols[6:]]
                    n = len(made)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), ids.slice(first, n), train.slice(first, n),
                        *[pa.array(c, pa.int64()) for c in cols[2:4]], *[pa.array(c, pa.float64()) for c in cols[4:6]], *arrays], names=names)
                    made, first, held = [], k + 1, 0
    return batches


def score(docs: DataFrame, train: Column, path: str, rounds: int = 1, head: int = HEAD) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    The word counts and the pieces' probabilities come from the rows where ``train`` holds; ``rounds`` is how often the
    cuts of the training words are weighed again. Null and empty texts are one end. Equal texts get equal scores, repeated
    rows are documents of their own. Without training rows the vocabulary's own weights score, and every token is unknown.
    An empty table gives no rows. Whole texts are read; columns other than doc_id, text and those of ``train`` are not.
    """
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    known = vocabulary(path)
    counts = docs.select("text", "train").mapInArrow(_count, "word binary, c long, everywhere long")
    counts = Stored(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere")),
                    {"tokens": F.sum("c"), "distinct": F.sum((F.col("c") > 0).cast("long")), "all": F.sum("everywhere")})
    tokens, distinct, everywhere = (counts.measures[k] or 0 for k in ("tokens", "distinct", "all"))
    weights = known.weights
    for _ in range(rounds):
        found = counts.table.select("word", "c").mapInArrow(_expected(path, weights), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        weights = learned(known, {r.piece: r.n / GRAIN for r in found.collect()})  # at most a row for each piece
    weighed = Stored(counts.table.mapInArrow(_weighed(path, weights), "w long, v int, c long, everywhere long, log_p double"))
    counts.drop()

    enough = max(1, -(-everywhere // head))
    top = weighed.table.where(F.col("everywhere") >= F.lit(enough)).select("w", "v", "c", "log_p").orderBy("w").toArrow()  # at most ``head`` rows
    frequent = Frequent(*[top.column(c).to_numpy() for c in ("w", "v", "c", "log_p")])
    kind = dict(docs.dtypes)["doc_id"]
    rows = Stored(docs.mapInArrow(_documents(frequent), f"part long, no long, doc_id {kind}, train boolean, n_tokens long, known long, "
                                  "logs double, log_p double, w array<long>, v array<int>, tf array<long>")).table
    rest = weighed.table.where(F.col("everywhere") < F.lit(enough)).select("w", "v", "c", F.col("log_p").alias("one"))
    asked = rows.select("part", "no", F.explode(F.arrays_zip("w", "v", "tf")).alias("x")).select("part", "no", "x.*")
    found = asked.join(rest, ["w", "v"]).groupBy("part", "no").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_logs"),
        F.sum(F.col("tf") * F.col("one")).alias("more_log_p"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    log_size = math.log10(tokens + distinct + 1)
    return rows.drop("w", "v", "tf").join(found, ["part", "no"], "left").select(
        "doc_id", "train", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (plus("logs", "more_logs") - F.col("n_tokens") * F.lit(log_size)).alias("base_score"), plus("log_p", "more_log_p").alias("score"))


def op11_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), training(), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
