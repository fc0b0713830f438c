"""Document quality by attention-based multiple-instance learning.

Method: a document is a bag of passages, the runs of ``PASSAGE_WORDS`` words of its whole text.
Every passage is described by the shares of pairs of adjacent character classes in it, by its
word lengths and by how much of it repeats earlier words and four-word runs of the document. A
learned layer encodes each description, gated attention (tanh times sigmoid) gives each passage
a weight within its document, and a logistic layer scores the weighted sum. All layers are
learned together from document labels alone.

Scale: the fit reads a sample of at most ``MAX_TRAIN_ROWS`` labelled documents and
``MAX_TRAIN_BYTES`` of text in one task; scoring is a narrow pass over all rows without a shuffle.

Edge cases: a text without words (null, empty, blank) is one passage of zeros; null labels are
not used; without labelled rows the score is 0.5; ids may be null or repeat; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import release_memory, small_batches, text_or_empty
from ._training import fit_in_one_task, fold_of, labelled_sample
from .words import row_chunks, words_in

PASSAGE_WORDS = 48
MAX_TRAIN_ROWS = 6_144
MAX_TRAIN_BYTES = 24_000_000
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE, DECAY = 24, 32, 0.003, 1e-4
CLASSES = 16
FEATURES = CLASSES * CLASSES + 5


def _character_classes() -> np.ndarray:
    groups = ["bcdfghjklmnpqrstvwxyz", "aeiou", "BCDFGHJKLMNPQRSTVWXYZ", "AEIOU", "0123456789", " ", "\n\r\t\v\f", ".", ",;:", "!?", "|", "&$#%*@^~+=<>", "\"'`()[]{}", "-_/\\"]
    table = np.full(256, 14, np.int64)
    table[0x80:] = 15
    for k, members in enumerate(groups):
        table[list(members.encode())] = k
    return table


_CLASS = _character_classes()


def _first_seen(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each entry is the first with its value in its row."""
    first = np.zeros(len(row), bool)
    _, at = np.unique(value ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first[at] = True
    return first


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages (float32) and the bounds of each row's passages."""
    blocks, counts = [], []
    for _, data, offsets in row_chunks(column):
        words = words_in(data, offsets)
        per_row = np.maximum(1, -(-words.counts // PASSAGE_WORDS))
        bounds = np.r_[0, np.cumsum(per_row)]
        total = bounds[-1]
        x = np.zeros((total, FEATURES), np.float32)
        if len(words.hash):
            row = words.row()
            place = bounds[row] + (np.arange(len(row)) - words.bounds[row]) // PASSAGE_WORDS
            size = np.bincount(place, minlength=total)
            mean = lambda v: np.bincount(place, v, minlength=total) / np.maximum(size, 1)
            # A passage reaches from its first word to the first word of the next one, or to its row's end.
            opening = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            begins, owner = words.start[opening], place[opening]
            ends = np.minimum(np.r_[begins[1:], len(data)], offsets[row[opening] + 1])
            chars = _CLASS[data]
            pair = chars[:-1] * CLASSES + chars[1:]
            spans = np.maximum(ends - begins - 1, 0)
            at = np.repeat(begins - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
            counted = np.bincount(np.repeat(owner, spans) * CLASSES**2 + pair[at], minlength=total * CLASSES**2)
            shares = counted.reshape(total, -1) / np.maximum(1, np.bincount(owner, spans, minlength=total))[:, None]
            x[:, : CLASSES**2] = np.sqrt(shares)
            x[:, -5] = np.log1p(mean((words.end - words.start).astype(float)))
            x[:, -4] = mean(_first_seen(row, words.hash))
            runs, run_bounds = words.shingles(4)
            new = np.r_[_first_seen(np.repeat(np.arange(len(words.counts)), np.diff(run_bounds)), runs), True]
            # The words at the end of a row that begin no run count as its last run does.
            run = np.minimum(run_bounds[row] + np.arange(len(row)) - words.bounds[row], run_bounds[row + 1] - 1)
            x[:, -3] = mean(new[run])
            x[:, -2] = np.log1p(size) / 4
            x[:, -1] = np.log1p(words.counts)[np.repeat(np.arange(len(per_row)), per_row)] / 10
        blocks.append(x)
        counts.append(per_row)
    if not blocks:
        return np.zeros((0, FEATURES), np.float32), np.zeros(1, np.int64)
    return np.concatenate(blocks), np.r_[0, np.cumsum(np.concatenate(counts))]


class AttentionModel:
    """Encoder, gated attention over a document's passages, and a logistic output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"We": draw(FEATURES, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0] * 0.1, "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.fitted = False

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, bounds[:-1]
        doc = np.repeat(np.arange(len(first)), np.diff(bounds))
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["We"] + p["be"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        e = np.exp(a - np.maximum.reduceat(a, first)[doc])
        weight = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(weight[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "y": y, "doc": doc, "first": first}

    def gradients(self, f: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, doc, first = self.p, f["doc"], f["first"]
        dy = ((f["y"] - labels) / len(labels)).astype(np.float32)
        dz = dy[:, None] * p["c"]
        dh = f["weight"][:, None] * dz[doc]
        dweight = (f["h"] * dz[doc]).sum(1)
        mean = np.add.reduceat(f["weight"] * dweight, first)
        da = f["weight"] * (dweight - mean[doc])
        dt = da[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = da[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"We": f["x"].T @ dh, "be": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> None:
        self.mean = x.mean(0)
        # In parts, as the differences of all passages would take as much memory as the passages.
        parts = [((x[at : at + 4096] - self.mean) ** 2).sum(0) for at in range(0, len(x), 4096)]
        self.scale = (np.sqrt(sum(parts) / len(x)) + 0.02).astype(np.float32)
        self.fitted = True
        r = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                docs = order[at : at + BATCH]
                sizes = bounds[docs + 1] - bounds[docs]
                own = np.r_[0, np.cumsum(sizes)]
                rows = np.repeat(bounds[docs] - own[:-1], sizes) + np.arange(own[-1])
                grads = self.gradients(self.forward(x[rows], own), labels[docs])
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - RATE * (move + DECAY * self.p[k])).astype(np.float32)

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.full(len(column), 0.5)
        out = []
        for at in range(0, len(column), 512):
            x, bounds = passages(column.slice(at, 512))
            out.append(self.forward(x, bounds)["y"])
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit_attention(texts: pa.Array, labels: np.ndarray) -> AttentionModel:
    model = AttentionModel()
    if len(texts):
        x, bounds = passages(texts)
        model.fit(x, bounds, labels.astype(np.float32))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_fold: int = 1, id_col: str = "doc_id") -> AttentionModel:
    """A model learned from labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label_col, fold_of("id", folds) != held_fold, MAX_TRAIN_ROWS, MAX_TRAIN_BYTES, id_col)
    return fit_in_one_task(sample, fit_attention)


def with_score(docs: DataFrame, model: AttentionModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from (pa.array(shared.value.score(texts), pa.float64()) for texts in batches)
        release_memory()

    small_batches(docs.sparkSession)
    return docs.withColumn(out, apply(text_or_empty(text_col)))


def score(docs: DataFrame, model: AttentionModel, folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, held_out, score and predicted (1 where the score is 0.5 or more)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select(
        F.col("id").alias(id_col),
        F.coalesce(fold_of("id", folds) == held_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
