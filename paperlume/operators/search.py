"""Search of many questions at once over all chunks: words by cover density, vectors by cosine.

The questions travel, the chunks do not. A block of questions, bounded by rows and bytes, is broadcast;
each task reads its chunks in Arrow batches, scores them against the whole block as matrices and
keeps the best of each question; only these are shuffled. No posting, no text and no pair of
a frequent word is ever a row.

Words: a chunk's words of letters and digits are stemmed and have positions, stop words included in
the count. A question is asked twice. Loosely, any of its meaning words (a hyphenated one as a phrase)
is searched, and each place where one stands is a cover. Strictly, all its words have to occur:
"quoted words" next to each other, ``-word`` not at all, and ``or`` between alternatives. A chunk
scores 0.1 for each cover divided by one and the words in it that are not sought, and twice that if it matches
strictly as well. Where a question has no meaning words the strict one is searched itself; its
covers are the least spans that hold all its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stems import STOPS, stem
from ..functions.text import lexical_terms, normalise_question

#: Best chunks of a question and kind. Fixed value.
POOL = 40
#: Questions of a block, at most, and bytes of their vectors; questions and chunks that are scored as one matrix.
BLOCK, BLOCK_BYTES, WIDE, TALL = 10_000, 64_000_000, 256, 256
COVER, STRICT = 0.1, 2.0
_APART = r"[^\p{L}\p{N}]+"
_TOKEN = re.compile(r"[^\W_]+")


def top_per_question(scored: DataFrame, k: int = POOL) -> DataFrame:
    """The ``k`` best chunks of each question with their rank; ties go to the smaller id."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The best ``k`` chunks of each of some questions so far; ties go to the smaller chunk."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.ids = np.zeros((k, questions), np.int64)
        self.scores = np.full((k, questions), -np.inf)

    def reached(self, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Which of ``scores`` (chunks, questions) would be among the best."""
        least, last = self.scores[-1], self.ids[-1]
        return (scores > least) | ((scores == least) & (ids[:, None] < last))

    def add(self, ids: np.ndarray, scores: np.ndarray, some: np.ndarray | slice = slice(None)) -> None:
        """``scores`` (chunks, questions), or of ``some`` questions; what is -inf is no candidate."""
        ids = np.vstack([self.ids[:, some], np.repeat(ids[:, None], scores.shape[1], 1)])
        scores = np.vstack([self.scores[:, some], scores])
        if len(scores) > 4 * self.k:
            near = np.argpartition(-scores, self.k - 1, axis=0)[: self.k]
            least = np.take_along_axis(scores, near, 0).min(0)
            # All that tie with the last one stay until they are ordered.
            rows = np.flatnonzero((scores >= least).any(1))
            ids, scores = ids[rows], scores[rows]
        order = np.argsort(ids, axis=0, kind="stable")
        ids, scores = np.take_along_axis(ids, order, 0), np.take_along_axis(scores, order, 0)
        order = np.argsort(-scores, axis=0, kind="stable")[: self.k]
        self.ids[:, some], self.scores[:, some] = np.take_along_axis(ids, order, 0), np.take_along_axis(scores, order, 0)

    def rows(self, questions: np.ndarray) -> pa.RecordBatch:
        at, q = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(questions[q]), pa.array(self.ids[at, q]), pa.array(self.scores[at, q])], names=["question_id", "chunk_id", "score"])


_FOUND = "question_id long, chunk_id long, score double"


def _in_blocks(chunks: DataFrame, questions: DataFrame, block: int, k: int, task: Callable) -> DataFrame:
    """``task`` of (the rows of a block of questions, k) over the chunks, block after block, and the best of all tasks.

    A block's rows are collected for their broadcast: about ``block`` of them.
    """
    spark, blocks = chunks.sparkSession, max(1, -(-questions.count() // block))

    def search(own: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(own.toArrow())
        return top_per_question(chunks.mapInArrow(task(shared, k), _FOUND), k)

    place = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (search(questions.where(place == at)) for at in range(blocks)))


def semantic_search(chunks: DataFrame, questions: DataFrame, k: int = POOL, block: int = BLOCK) -> DataFrame:
    """Exact cosine search of all questions against all chunks: (question_id, chunk_id, score, rank).

    Blocks have at most ``block`` questions and ``BLOCK_BYTES`` of vectors. Rows whose vector is null, zero or of another
    length than the question's neither ask nor answer; a chunk does not answer a question of its own id.
    """
    asked = questions.where("embedding IS NOT NULL").select("question_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    longest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    held = chunks.where("embedding IS NOT NULL").select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def task(shared, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted: dict[int, tuple[np.ndarray, np.ndarray, list[Best]]] = {}
            for length, ids, unit in _units(shared.value.combine_chunks().to_batches()):
                wanted[length] = (ids, unit, [Best(len(ids[at : at + WIDE]), k) for at in range(0, len(ids), WIDE)])
            for batch in batches:
                for length, ids, unit in _units([batch]):
                    if length not in wanted:
                        continue
                    own, vectors, best = wanted[length]
                    for at in range(0, len(ids), 4 * TALL):
                        part, rows = ids[at : at + 4 * TALL], unit[at : at + 4 * TALL]
                        for n, kept in enumerate(best):
                            some = slice(n * WIDE, (n + 1) * WIDE)
                            scores = np.round(rows @ vectors[some].T, 9)
                            scores[part[:, None] == own[some][None]] = -np.inf
                            kept.add(part, scores)
            for own, _, best in wanted.values():
                for n, kept in enumerate(best):
                    yield kept.rows(own[n * WIDE : (n + 1) * WIDE])

        return run

    return _in_blocks(held, asked, max(1, min(block, BLOCK_BYTES // (8 * longest))), k, task)


def _units(batches: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and unit vectors of the rows of each length in (id, v)."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == length)
            v = flat[starts[rows][:, None] + np.arange(length)]
            norm = np.sqrt((v * v).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            yield length, ids[rows][good], v[good] / norm[good][:, None]


@dataclass
class Item:
    """Stems next to each other: (stem, how far behind the first), and whether a chunk must not have them."""

    stems: list[tuple[str, int]]
    without: bool = False


@dataclass
class Asked:
    """A question: loose items, any of which may occur, and strict alternatives, all of whose items must."""

    loose: list[Item] = field(default_factory=list)
    strict: list[list[Item]] = field(default_factory=list)


def _item(words: str, without: bool = False) -> Item | None:
    found = [(stem(w), k) for k, w in enumerate(_TOKEN.findall(words)) if w not in STOPS]
    return Item([(s, k - found[0][1]) for s, k in found], without) if found else None


def understood(question: str, terms: list[str]) -> Asked:
    """A question in its normal form, with its meaning words."""
    out, group = Asked([i for i in map(_item, terms) if i]), []
    for without, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', question.lower()):
        if word == "or" and not without:
            out.strict.append(group)
            group = []
        elif item := _item(quoted or word, bool(without)):
            group.append(item)
    out.strict = [g for g in [*out.strict, group] if any(not i.without for i in g)]
    return out


def _places(item: Item, held: dict[str, np.ndarray]) -> np.ndarray:
    """Where the item begins in a chunk, given the sorted positions of stems."""
    none = np.zeros(0, np.int64)
    at = held.get(item.stems[0][0], none)
    for name, behind in item.stems[1:]:
        at = at[np.isin(at + behind, held.get(name, none))]
    return at


def matches(group: list[Item], held: dict[str, np.ndarray]) -> bool:
    return all((len(_places(i, held)) > 0) != i.without for i in group)


def covers(group: list[Item], held: dict[str, np.ndarray]) -> float:
    """0.1 for each least span that holds all items of a group, divided by one and the words in it that are not sought."""
    wanted = [i for i in group if not i.without]
    if not matches(group, held):
        return 0.0
    starts = [(int(p), int(p) + i.stems[-1][1], k) for k, i in enumerate(wanted) for p in _places(i, held)]
    sought = np.unique(np.concatenate([held[s] for i in wanted for s, _ in i.stems]))
    starts.sort(key=lambda x: (x[1], x[0]))
    latest: dict[int, int] = {}
    total, before = 0.0, -1
    for at, (begin, end, k) in enumerate(starts):
        latest[k] = max(latest.get(k, -1), begin)
        # All that end here are taken in before a span ends here.
        if len(latest) == len(wanted) and (at + 1 == len(starts) or starts[at + 1][1] > end):
            first = min(latest.values())
            if first > before:
                inside = int(np.searchsorted(sought, end, "right") - np.searchsorted(sought, first))
                total += COVER / (1 + (end - first + 1 - inside))
                before = first
    return total


def lexical_search(chunks: DataFrame, questions: DataFrame, k: int = POOL, block: int = BLOCK) -> DataFrame:
    """The best chunks of each question by its words: (question_id, chunk_id, score, rank); see the module for scores."""
    asked = questions.select("question_id", F.lower(normalise_question(F.col("question"))).alias("question"), F.array_distinct(lexical_terms(F.col("question"))).alias("terms"))
    held = chunks.where("text IS NOT NULL").select("chunk_id", "text")

    def task(shared, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value.to_pylist()
            parts = [_Scorer([(r["question_id"], understood(r["question"] or "", r["terms"] or [])) for r in rows[at : at + WIDE]], k) for at in range(0, len(rows), WIDE)]
            vocabulary = {s for part in parts for s in part.names}
            names = {s: n for n, s in enumerate(sorted(vocabulary))}
            for part in parts:
                part.bind(names)
            for batch in batches:
                for at in range(0, len(batch), TALL):
                    ids, text = (batch.column(c).slice(at, TALL) for c in (0, 1))
                    found = _positions(text, names)
                    for part in parts:
                        part.add(ids.to_numpy(zero_copy_only=False), *found)
            for part in parts:
                yield part.best.rows(part.ids)

        return run

    return _in_blocks(held, asked, block, k, task)


def _positions(texts: pa.Array, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk, number of the stem and position of every word whose stem is named; each distinct word is stemmed once."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), _APART)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = split.flatten().dictionary_encode()
    own = np.array([names.get(stem(w), -1) if w and w not in STOPS else -1 if w else -2 for w in words.dictionary.to_pylist()], np.int64)
    number = own[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    # What the pattern leaves empty at the ends of a text is no word and has no place.
    chunk, number = chunk[number > -2], number[number > -2]
    first = np.searchsorted(chunk, np.arange(len(sizes)))
    place = np.arange(len(chunk)) - first[chunk]
    named = number >= 0
    return chunk[named], number[named], place[named]


class _Scorer:
    """Scores chunks against some questions and keeps the best.

    Single words and plain alternatives are counted by products of matrices. Whether a chunk matches strictly
    is asked only where twice its score would be among the best so far; there is no other way up.
    """

    def __init__(self, questions: list[tuple[int, Asked]], k: int):
        self.ids = np.array([q for q, _ in questions], np.int64)
        self.asked, self.best = [a for _, a in questions], Best(len(questions), k)
        self.names = {s for a in self.asked for i in (*a.loose, *(i for g in a.strict for i in g)) for s, _ in i.stems}
        # Phrases and spans are counted one by one.
        self.phrases = [(q, i) for q, a in enumerate(self.asked) for i in a.loose if len(i.stems) > 1]
        self.spanning = np.array([q for q, a in enumerate(self.asked) if not a.loose], np.int64)
        # A chunk that has all stems of an alternative may match it; of most, the only one of a question, that is all there is to it.
        groups = [(q, g, {s for i in g if not i.without for s, _ in i.stems}) for q, a in enumerate(self.asked) for g in a.strict]
        plain = [bool(self.asked[q].loose) and len(self.asked[q].strict) == 1 and all(len(i.stems) == 1 and not i.without for i in g) for q, g, _ in groups]
        self.plain, self.others = ([x for x, p in zip(groups, plain) if p is kind] for kind in (True, False))

    def bind(self, names: dict[str, int]) -> None:
        """Number this scorer's stems, given the numbers of all."""
        self.column = {s: n for n, s in enumerate(sorted(self.names))}
        self.own = np.full(len(names), -1)
        self.own[[names[s] for s in self.column]] = list(self.column.values())
        self.asks = np.zeros((len(self.column), len(self.asked)), np.float32)
        for q, a in enumerate(self.asked):
            self.asks[[self.column[i.stems[0][0]] for i in a.loose if len(i.stems) == 1], q] = 1
        self.needs = np.zeros((len(self.column), len(self.plain)), np.float32)
        for n, (_, _, needs) in enumerate(self.plain):
            self.needs[[self.column[s] for s in needs], n] = 1
        self.plain_of = np.array([q for q, _, _ in self.plain], np.int64)

    def add(self, ids: np.ndarray, chunk: np.ndarray, number: np.ndarray, place: np.ndarray) -> None:
        if not self.names:
            return
        width, term = len(self.column), self.own[number]
        chunk, term, place = chunk[term >= 0], term[term >= 0], place[term >= 0]
        code = chunk * width + term
        counts = np.bincount(code, minlength=len(ids) * width).reshape(len(ids), width).astype(np.float32)
        scores = COVER * np.round(counts @ self.asks).astype(np.float64)
        order: list[np.ndarray] = []

        def held(c: int, stems: set[str]) -> dict[str, np.ndarray]:
            if not order:
                by = np.lexsort((place, code))
                order.extend((code[by], place[by]))
            codes, places = order
            ends = [np.searchsorted(codes, c * width + self.column[s], side) for s in stems for side in ("left", "right")]
            return {s: places[a:b] for s, a, b in zip(stems, ends[::2], ends[1::2])}

        def final(strictly: np.ndarray) -> np.ndarray:
            found = np.round(np.where(strictly, STRICT, 1.0) * scores.astype(np.float32), 6)
            return np.where(scores > 0, found, -np.inf)

        present = counts > 0
        for q, item in self.phrases:
            stems = {s for s, _ in item.stems}
            for c in np.flatnonzero(present[:, [self.column[s] for s in stems]].all(1)).tolist():
                scores[c, q] += COVER * len(_places(item, held(c, stems)))
        may = self.best.reached(ids, final(np.True_)) & (scores > 0)
        may[:, self.spanning] = True
        strictly = np.zeros(scores.shape, bool)
        some = np.flatnonzero(may[:, self.plain_of].any(0))
        rows = np.flatnonzero(may[:, self.plain_of].any(1))
        if len(some):
            needs = self.needs[:, some]
            strictly[rows[:, None], self.plain_of[some]] = present[rows].astype(np.float32) @ needs > needs.sum(0) - 0.5
        for q, group, needs in self.others:
            rows = np.flatnonzero(may[:, q])
            every = needs | {s for i in group for s, _ in i.stems}
            for c in rows[present[np.ix_(rows, [self.column[s] for s in needs])].all(1)].tolist():
                where = held(c, every)
                if matches(group, where):
                    strictly[c, q] = True
                    if not self.asked[q].loose:
                        scores[c, q] += covers(group, where)
        scores = final(strictly)
        better = self.best.reached(ids, scores) & (scores > 0)
        rows, some = np.flatnonzero(better.any(1)), np.flatnonzero(better.any(0))
        if len(some):
            self.best.add(ids[rows], scores[np.ix_(rows, some)], some)
