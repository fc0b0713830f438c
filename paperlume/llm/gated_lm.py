"""Log-likelihood of whole documents under a gated recurrent language model.

Method: words and an end symbol are tokens. The ``SYMBOLS`` - 2 most frequent training words have
symbols of their own; the others share one. A gated recurrent unit reads the symbols one by one;
the next symbol's probability is that of its class times its probability within the class, both
softmaxes. Words that share the symbol get that probability times their smoothed share among such
words in the training rows. The unit is trained in numpy by truncated backpropagation on every training
row once: in each of ``ROUNDS`` rounds up to ``TRAINERS`` tasks go on with their part of the round's
rows, and their weights are averaged. A hash of id and text deals a row to its round and trainer and
sets its place there, so scores do not depend on how files are cut. Scoring carries the state from window to window through the whole document.

The base score is that of a smoothed unigram model. Counts cover all training rows: they are
pre-aggregated in each task and shuffled by word. Frequent words' counts, ``HEAD_WORDS`` at most,
travel to the tasks; those of all other words are joined to their occurrences by a shuffle.

Scale: two narrow passes over all texts, and one that writes the training rows' symbols (two bytes a
token), of which each round shuffles its part to the trainers. What is shuffled are a task's distinct words, and
occurrences of rare words. A task holds about ``GROUP_TOKENS`` tokens, or one longer document.

Edge cases: null and empty texts have the end token alone; a null id is not held out; repeated
ids are separate rows; with no training rows all words are unknown; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import releasing, scratch, text_or_empty, written
from .words import row_chunks, words_in

HIDDEN, CLASSES, PER_CLASS = 16, 32, 32
SYMBOLS = CLASSES * PER_CLASS
END, OTHER = 0, 1
HEAD_WORDS = 1 << 18
#: Tokens that are scored together, and that a trainer holds at a time.
GROUP_TOKENS, TRAIN_TOKENS = 3_000_000, 2_000_000
#: Training: every row belongs to one of the rounds; a trainer has about ``TRAINER_TOKENS`` of a round at least.
ROUNDS, TRAINERS, TRAINER_TOKENS = 8, 256, 800_000
#: A run of symbols is cut into lanes that take about ``STEPS`` steps of the optimiser, at most ``LANES`` of them.
LANES, STEPS, WINDOW, RATE = 256, 200, 20, 0.01
#: The end token in counts of words; words hash to other values with all but certainty.
END_WORD = np.uint64(0)
_COUNT_LIMIT = 4_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in the place of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class GatedUnit:
    """A gated recurrent unit with a class-factored softmax; ``seen`` is the number of tokens it was trained on."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        self.seen, self.moments = 0, None
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        share = (counts + 0.5) / (counts + 0.5).sum()
        by_class = share.reshape(CLASSES, PER_CLASS)
        self.p = {
            "G": draw(SYMBOLS, 3 * HIDDEN), "U": draw(HIDDEN, 3 * HIDDEN),
            "Wc": draw(HIDDEN, CLASSES), "bc": np.log(by_class.sum(1)).astype(np.float32),
            "Ww": draw(CLASSES, HIDDEN, PER_CLASS), "bw": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        }

    def states(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the inputs x (steps, lanes), from h; an end symbol starts anew."""
        out = np.empty((*x.shape, HIDDEN), np.float32)
        into, u = self.p["G"], self.p["U"]
        ends = x == END
        some = ends.any(1)
        for t in range(len(x)):
            if some[t]:
                h = h * ~ends[t][:, None]
            g, a = into[x[t]], h @ u
            zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
            _sigmoid(zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = r * a[:, 2 * HIDDEN :]
            n += g[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of symbols y (n) after states h (n, HIDDEN), and its gradient by h where asked for."""
        cls, member = y // PER_CLASS, y % PER_CLASS
        every = np.arange(len(y))
        logits = h @ self.p["Wc"] + self.p["bc"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        out = logits[every, cls] - np.log(total)
        dh = None
        if grads is not None:
            d = -e / total[:, None]
            d[every, cls] += 1
            grads["Wc"] += h.T @ d
            grads["bc"] += d.sum(0)
            dh = d @ self.p["Wc"].T
        # Rows of one class lie side by side, so its part of every array is a slice.
        order = np.argsort(cls, kind="stable")
        sorted_h, sorted_member = h[order], member[order]
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        gained = np.empty(len(y), out.dtype)
        later = np.empty_like(h) if grads is not None else None
        for c in np.flatnonzero(np.diff(ends)).tolist():
            part = slice(ends[c], ends[c + 1])
            own, at, mine = sorted_h[part], every[: ends[c + 1] - ends[c]], sorted_member[part]
            logits = own @ self.p["Ww"][c]
            logits += self.p["bw"][c]
            logits -= logits.max(1, keepdims=True)
            known = logits[at, mine]
            np.exp(logits, out=logits)
            total = logits.sum(1)
            gained[part] = known - np.log(total)
            if grads is not None:
                logits /= -total[:, None]
                logits[at, mine] += 1
                grads["Ww"][c] += own.T @ logits
                grads["bw"][c] += logits.sum(0)
                later[part] = logits @ self.p["Ww"][c].T
        out[order] += gained
        if grads is not None:
            dh[order] += later
        return out, dh

    def backward(self, x: np.ndarray, kept: list, dh: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Adds the gradients of a window; dh (steps, lanes, HIDDEN) comes from the outputs."""
        later, into = np.zeros_like(dh[0]), np.empty((*x.shape, 3 * HIDDEN), np.float32)
        for t in reversed(range(len(x))):
            h, z, r, n, a = kept[t]
            d = dh[t] + later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            into[t] = np.concatenate([dz, dr, dn], axis=1)
            grads["U"] += h.T @ da
            later = (d * z + da @ self.p["U"].T) * (x[t] != END)[:, None]
        # Rows of one symbol are added up together.
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        own = flat[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        grads["G"][own[first]] += np.add.reduceat(into.reshape(-1, 3 * HIDDEN)[order], first)

    def train(self, symbols: np.ndarray, epochs: int) -> None:
        """Truncated backpropagation over one long run of symbols, cut into lanes."""
        lanes = int(np.clip(len(symbols) // (STEPS * WINDOW), 1, LANES))
        steps = -(-len(symbols) // lanes)
        if not steps:
            return
        # End symbols fill the last lane.
        y = np.r_[symbols, np.full(lanes * steps - len(symbols), END)].reshape(lanes, steps).T
        x = np.vstack([np.full((1, lanes), END), y[:-1]])
        # The optimiser goes on where the run before has left it.
        first, second, step = self.moments or (*({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), 0)
        for _ in range(epochs):
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, steps, WINDOW):
                own, kept = slice(t, t + WINDOW), []
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                states = self.states(x[own], h, kept)
                h = states[-1]
                _, dh = self.log_probs(states.reshape(-1, HIDDEN), y[own].ravel(), grads)
                self.backward(x[own], kept, dh.reshape(states.shape), grads)
                step += 1
                for k, g in grads.items():
                    g /= y[own].size
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.005 * (g * g - second[k])
                    self.p[k] += RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-7)
        self.moments = first, second, step

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each document's symbols, the state carried through the whole of it.

        Documents are dealt to as many lanes as the longest of them fits into their total, so
        the padded matrix is never much larger than they are.
        """
        total, longest = sum(map(len, documents)), max(map(len, documents))
        lanes = int(np.clip(total // longest, 1, 384))
        heap = [(0, k) for k in range(lanes)]
        members: list[list[int]] = [[] for _ in range(lanes)]
        for k in sorted(range(len(documents)), key=lambda k: -len(documents[k])):
            filled, lane = heapq.heappop(heap)
            members[lane].append(k)
            heapq.heappush(heap, (filled + len(documents[k]), lane))
        runs = [np.concatenate([documents[k] for k in own]) for own in members if own]
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        sizes = np.array([len(runs[k]) for k in order])
        y = np.full((sizes[0], len(order)), END, np.int32)
        for lane, k in enumerate(order):
            y[: len(runs[k]), lane] = runs[k]
        x = np.vstack([np.full((1, len(order)), END, np.int32), y[:-1]])
        gained = np.zeros(y.shape, np.float32)
        h = np.zeros((len(order), HIDDEN), np.float32)
        step = 64
        for t in range(0, len(y), step):
            live = int((sizes > t).sum())
            states = self.states(x[t : t + step, :live], h[:live])
            h = states[-1]
            found, _ = self.log_probs(states.reshape(-1, HIDDEN), y[t : t + step, :live].ravel())
            gained[t : t + step, :live] = found.reshape(states.shape[:2])
        out = np.zeros(len(documents))
        filled_members = [members[k] for k in range(lanes) if members[k]]
        for lane, k in enumerate(order):
            at = np.cumsum([0, *(len(documents[j]) for j in filled_members[k])])
            own = np.add.reduceat(gained[: sizes[lane], lane].astype(np.float64), at[:-1])
            out[filled_members[k]] = own
        return out / np.log(10)


@dataclass
class Corpus:
    """Counts of the frequent words, totals, and the symbols of the most frequent."""

    words: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    total: int
    distinct: int
    other_total: int
    other_distinct: int
    symbol_counts: np.ndarray

    def lookup(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent ones, or -1."""
        if not len(self.words):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        return np.where(self.words[at] == hashed, at, -1)

    def symbols(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.symbol[place], OTHER) if len(self.symbol) else np.full(len(place), OTHER)


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and bounds of successive rows."""
    for base, data, offsets in row_chunks(column):
        words = words_in(data, offsets)
        yield base, np.maximum(words.hash, np.uint64(1)), words.bounds


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over all rows of (id, text); the end token counts once a row."""

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(words)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, hashed, bounds in _tokens(batch.column(1)):
                parts.append(np.unique(hashed, return_counts=True))
                parts.append((np.array([END_WORD]), np.array([len(bounds) - 1])))
                held += len(parts[-2][0])
                if held > _COUNT_LIMIT:
                    parts = [merge(parts)]
                    held = len(parts[0][0])
                    if held > _COUNT_LIMIT // 2:
                        yield from emit(parts[0])
                        parts, held = [], 0
        if parts:
            yield from emit(merge(parts))

    def emit(counted: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, counts = counted
        for at in range(0, len(words), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 200_000].view(np.int64)), pa.array(counts[at : at + 200_000])], names=["word", "c"])

    return rows.mapInArrow(releasing(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def describe(counts: DataFrame) -> Corpus:
    """Totals, and the frequent words: those above the least count that ``HEAD_WORDS`` of them reach."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).collect()  # a few hundred rows
    total, distinct = sum(r["c"] for r in levels), sum(r["words"] for r in levels)
    held, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["words"]
        if held > HEAD_WORDS:
            break
        least = r["level"]
    head = counts.where(level >= least if least is not None else F.lit(False)).select("word", "c").toArrow()  # HEAD_WORDS rows at most
    words, c = head["word"].to_numpy().astype(np.int64).view(np.uint64), head["c"].to_numpy().astype(np.int64)
    order = np.argsort(words)
    words, c = words[order], c[order]
    symbol = np.full(len(words), OTHER, np.int64)
    ranked = [k for k in np.lexsort((words, -c)) if words[k] != END_WORD][: SYMBOLS - 2]
    symbol[ranked] = np.arange(2, 2 + len(ranked))
    symbol[words == END_WORD] = END
    own = symbol != OTHER
    sums = np.bincount(symbol, c, minlength=SYMBOLS) if len(c) else np.zeros(SYMBOLS)
    sums[OTHER] = total - c[own].sum()
    return Corpus(words, c, symbol, total, distinct, int(sums[OTHER]), distinct - int(own.sum()), sums)


def _training_symbols(rows: DataFrame, corpus: Broadcast) -> DataFrame:
    """Of each row of (id, text): its round and place, the number of its symbols with the end, and these as 16-bit integers.

    Round and place come from a hash of the row itself, so the cut of the files has no part in what is learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, hashed, bounds in _tokens(batch.column(2)):
                own = np.insert(corpus.value.symbols(corpus.value.lookup(hashed)), bounds[1:], END).astype("<u2")
                ends = bounds + np.arange(len(bounds))
                packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(own)])
                held = [batch.column(k).slice(base, len(bounds) - 1) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.diff(ends), pa.int64()), packed], names=["turn", "place", "n", "symbols"])

    place = F.xxhash64("id", "text")
    named = rows.select(F.pmod(place, F.lit(ROUNDS)).cast("int").alias("turn"), place.alias("place"), "text")
    # The rows of a round lie side by side in each file, so a round reads little of the others.
    return named.mapInArrow(releasing(run), "turn int, place long, n long, symbols binary").sortWithinPartitions("turn")


def train(rows: DataFrame, corpus: Corpus, shared: Broadcast | None = None) -> GatedUnit:
    """A unit trained on (id, text): on every row once, a part of them in each round.

    A round's rows are dealt to trainers by their places and come to them in that order.
    """

    def one(model: GatedUnit):
        packed = pickle.dumps(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A trainer goes on through all its rows, a bounded run of them at a time.
            unit, seen, parts, held, first = pickle.loads(packed), 0, [], 0, None
            for place, symbols in ((p.as_py(), x.as_py()) for batch in batches for p, x in zip(batch.column(0), batch.column(1))):
                first = place if first is None else first
                parts.append(np.frombuffer(symbols, "<u2"))
                held += len(parts[-1])
                if held >= TRAIN_TOKENS:
                    unit.train(np.concatenate(parts), 1)
                    seen, parts, held = seen + held, [], 0
            if held:
                unit.train(np.concatenate(parts), 1)
            if seen + held:
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([seen + held], pa.int64()), pa.array([pickle.dumps(unit.p)], pa.binary())], names=["first", "n", "weights"])

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One trainer after another, in order of their first rows, so sums are the same at every run.
        total, sums = 0, None
        for n, packed in ((n.as_py(), x.as_py()) for batch in batches for n, x in zip(batch.column(1), batch.column(2))):
            own = {k: n * v.astype(np.float64) for k, v in pickle.loads(packed).items()}
            total, sums = total + n, own if sums is None else {k: sums[k] + v for k, v in own.items()}
        if total:
            mean = {k: (v / total).astype(np.float32) for k, v in sums.items()}
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([pickle.dumps(mean)], pa.binary())], names=["n", "weights"])

    model = GatedUnit(corpus.symbol_counts)
    shared = shared or rows.sparkSession.sparkContext.broadcast(corpus)
    with scratch(rows.sparkSession):
        table = written(_training_symbols(rows, shared))
        for turn, n in sorted(map(tuple, table.groupBy("turn").agg(F.sum("n")).collect())):  # ROUNDS rows at most
            trainers = int(max(1, min(TRAINERS, n // TRAINER_TOKENS)))
            own = table.where(F.col("turn") == turn).select("place", "symbols").repartition(trainers, "place").sortWithinPartitions("place")
            trained = own.mapInArrow(releasing(one(model)), "first long, n long, weights binary")
            # The weights of TRAINERS trainers at most are summed up in one task; one row reaches the driver.
            merged = trained.repartition(1).sortWithinPartitions("first").mapInArrow(releasing(average), "n long, weights binary").first()
            model.seen += merged["n"]
            model.p = pickle.loads(merged["weights"])
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Per row: its id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    with scratch(docs.sparkSession):
        return written(_score(rows, id_col, folds, held_fold), keep=True)


def _score(rows: DataFrame, id_col: str, folds: int, held_fold: int) -> DataFrame:
    """The scores of (id, text), from step tables."""
    learned = rows.where(fold("id", folds) != held_fold)
    counts = written(word_counts(learned))
    corpus = describe(counts)
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(corpus)
    trained = context.broadcast(train(learned, corpus, shared))
    whole, others = corpus.total + 0.5 * (corpus.distinct + 1), corpus.other_total + 0.5 * (corpus.other_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unit = shared.value, trained.value
        group: list = []
        held = 0
        for batch in batches:
            for base, hashed, bounds in _tokens(batch.column(1)):
                group.append((batch.column(0).slice(base, len(bounds) - 1), hashed, bounds))
                held += len(hashed) + len(bounds) - 1
                if held >= GROUP_TOKENS:
                    yield _scored(known, unit, group, whole, others)
                    group, held = [], 0
        if group:
            yield _scored(known, unit, group, whole, others)

    columns = "id long, n_tokens long, n_known long, base double, score double, rare array<long>"
    scored = written(rows.mapInArrow(releasing(run), columns).withColumn("row", F.monotonically_increasing_id()))
    shared.unpersist()
    trained.unpersist()
    c = F.coalesce("c", F.lit(0))
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg(
        F.count_if(c > 0).alias("more_known"), F.sum(F.log10((c + 0.5) / whole)).alias("more_base"), F.sum(F.log10((c + 0.5) / others)).alias("more_score")
    )
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        (fold("id", folds) == held_fold).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _scored(corpus: Corpus, unit: GatedUnit, group: list, whole: float, others: float) -> pa.RecordBatch:
    """Scores of a group's rows, and the words of each that are not among the frequent ones."""
    ids = pa.concat_arrays([g[0] for g in group])
    sizes = np.concatenate([np.diff(g[2]) for g in group])
    hashed = np.concatenate([g[1] for g in group])
    bounds = np.r_[0, np.cumsum(sizes)]
    place = corpus.lookup(hashed)
    symbols = corpus.symbols(place)
    row = np.repeat(np.arange(len(sizes)), sizes)
    frequent = place >= 0
    c = np.where(frequent, corpus.counts[place], 0) if len(corpus.counts) else np.zeros(len(place))
    end = corpus.counts[corpus.words == END_WORD].sum()
    base = np.bincount(row, np.where(frequent, np.log10((c + 0.5) / whole), 0.0), minlength=len(sizes)) + np.log10((end + 0.5) / whole)
    spread = np.bincount(row, np.where(frequent & (symbols == OTHER), np.log10((c + 0.5) / others), 0.0), minlength=len(sizes))
    known = np.bincount(row, frequent, minlength=len(sizes)).astype(np.int64) + int(end > 0)
    documents = [np.append(symbols[a:b], END) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    rare = np.r_[0, np.cumsum(np.bincount(row, ~frequent, minlength=len(sizes)).astype(np.int64))]
    left = pa.LargeListArray.from_arrays(pa.array(rare), pa.array(hashed[~frequent].view(np.int64))).cast(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(unit.score(documents) + spread), left], names=["id", "n_tokens", "n_known", "base", "score", "rare"]
    )
