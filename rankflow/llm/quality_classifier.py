"""Quality classifier by co-training.

Two views of a document have a classifier each: its *text* (which kinds of characters follow each
other, how often words repeat) and its *metadata* (source, language, length). In each
round a view's classifier labels all unlabelled documents that it is certain of, and these
pseudo-labels join the training set of the *other* view. In the end both are calibrated on
labelled documents that were held out, and a last logistic model of the two
calibrated scores judges every document.

At most ``max_labelled`` labelled documents, drawn by the hash of the id, give their features (not
texts) to the driver. Of the unlabelled ones all take part: their features stay with the executors,
which send counts of metadata classes and the sums of Newton steps, both of fixed size. A kind of
pseudo-label weighs as much as SHARE of the labelled documents at most, however many rows it has.
Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.common import cut, map_arrow

#: Kinds of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII, 7 comma and stop, 8 ! and ?, 9 marks that prose lacks.
KINDS = 10
_KIND = np.zeros(256, np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n\r", 5), (bytes(range(128, 256)), 6), (b",.;:'", 7), (b"!?", 8), (b"#*$%&|<>@{}[]\\/=+~^_", 9)):
    _KIND[list(_chars)] = _k
TEXT_DIMS, SOURCE_DIMS, LANG_DIMS, LENGTH_DIMS = KINDS * KINDS + 4, 64, 16, 12
#: Weight of all pseudo-labels of one kind, in labelled documents; partial sums that reach the driver.
SHARE, SUMS = 0.25, 8


def text_features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of byte kind pairs, and of repeated words, lengths of words and texts."""
    out = np.zeros((len(texts), TEXT_DIMS))
    lengths = np.array([len(t) for t in texts])
    kinds = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), lengths)
    same = doc[1:] == doc[:-1]
    codes = (doc[:-1] * KINDS * KINDS + kinds[:-1] * KINDS + kinds[1:])[same]
    pairs = np.bincount(codes, minlength=len(texts) * KINDS * KINDS).reshape(len(texts), KINDS * KINDS)
    out[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(1, lengths - 1)[:, None])
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if n:
            out[i, -4:] = (1 - len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, min(40.0, len(text) / n) / 10, np.log1p(n) / 10)
    return out


def meta_features(sources: list, langs: list, lengths: list) -> np.ndarray:
    """One-hot source, language and length class, by hash; null is a value of its own."""
    out = np.zeros((len(sources), SOURCE_DIMS + LANG_DIMS + LENGTH_DIMS))
    for i, (source, lang, n) in enumerate(zip(sources, langs, lengths)):
        out[i, zlib.crc32(repr(source).encode()) % SOURCE_DIMS] = 1
        out[i, SOURCE_DIMS + zlib.crc32(repr(lang).encode()) % LANG_DIMS] = 1
        out[i, SOURCE_DIMS + LANG_DIMS + (0 if n is None or n != n else 1 + min(LENGTH_DIMS - 2, int(np.log2(max(0, n) + 1)) // 2))] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12, weight: np.ndarray | None = None, start: np.ndarray | None = None, more=None) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept.

    ``more`` gives the gradient and the Hessian of further rows at some weights.
    """
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1]) if start is None else start
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient, hessian = x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x
        if more is not None:
            g, h = more(w)
            gradient, hessian = gradient + g, hessian + h
        step = np.linalg.solve(hessian + np.diag(penalty + 1e-9), gradient + penalty * w)
        w = w - step
        if np.abs(step).max() < (1e-6 if more is None else 1e-4):
            break
    return np.round(w, 8)  # sums differ in their last bits with the order of partitions


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class Model:
    """Weights of both views, of their calibrations, and of the combination."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = _logit(_logit(xt, self.text)[:, None], self.text_scale)
        b = _logit(_logit(xm, self.meta)[:, None], self.meta_scale)
        return _sigmoid(a), _sigmoid(b), _sigmoid(_logit(np.column_stack([a, b]), self.both))


def _certain(logit: np.ndarray, found: np.ndarray | None, certain: float) -> np.ndarray:
    """Pseudo-labels: 1, 0, or -1 for none; those found before stay."""
    p = _sigmoid(logit)
    now = np.where(p >= certain, 1, np.where(1 - p >= certain, 0, -1))
    return now if found is None else np.where(found >= 0, found, now)


def _pool_labels(batch: pa.RecordBatch, history: list[list[np.ndarray]], certain: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text features, metadata classes, and what each view says of some unlabelled documents."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, TEXT_DIMS).astype(np.float64)
    cell, found = batch.column("cell").to_numpy(), [None, None]
    for text, meta in zip(*history):
        found = [_certain(z, f, certain) for z, f in zip((_logit(x, text), _logit(cell_features(cell), meta)), found)]
    return x, cell, found


def cells_of(xm: np.ndarray) -> np.ndarray:
    """Source, language and length class of metadata features as one number."""
    source, lang, length = (part.argmax(axis=1) for part in np.split(xm, [SOURCE_DIMS, SOURCE_DIMS + LANG_DIMS], axis=1))
    return ((source * LANG_DIMS + lang) * LENGTH_DIMS + length).astype(np.int32)


def cell_features(cells: np.ndarray) -> np.ndarray:
    """Metadata features of such numbers."""
    out, rows = np.zeros((len(cells), SOURCE_DIMS + LANG_DIMS + LENGTH_DIMS)), np.arange(len(cells))
    out[rows, cells // (LANG_DIMS * LENGTH_DIMS)] = 1
    out[rows, SOURCE_DIMS + cells // LENGTH_DIMS % LANG_DIMS] = 1
    out[rows, SOURCE_DIMS + LANG_DIMS + cells % LENGTH_DIMS] = 1
    return out


def pseudo_counts(pool: DataFrame, history: list[list[np.ndarray]], certain: float) -> pd.DataFrame:
    """``view, cell, label, n``: pseudo-labels of all unlabelled documents, counted; the metadata view's in one cell, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            _, cell, found = _pool_labels(batch, history, certain)
            for view, (f, c) in enumerate(zip(found, (cell, np.full(len(cell), -1)))):
                keys, n = np.unique(np.stack([c[f >= 0], f[f >= 0]]), axis=1, return_counts=True)
                for k, label, count in zip(*keys.tolist(), n.tolist()):
                    seen[view, k, label] = seen.get((view, k, label), 0) + count
        if seen:
            columns = [*zip(*seen)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(seen.values(), pa.int64())], ["view", "cell", "label", "n"])

    rows = map_arrow(pool, run, "view int, cell int, label int, n long").groupBy("view", "cell", "label").agg(F.sum("n").alias("n"))
    return rows.toPandas().sort_values(["view", "cell", "label"], kind="stable")


def newton_sums(pool: DataFrame, history: list[list[np.ndarray]], certain: float, weight: tuple[float, float], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian at ``w`` of the text view over all documents that the metadata view has labelled."""
    size = TEXT_DIMS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            x, _, (_, label) = _pool_labels(batch, history, certain)
            x, label = np.column_stack([x, np.ones(len(x))])[label >= 0], label[label >= 0]
            p, each = _sigmoid(x @ w), np.array(weight)[label]
            total[0] += x.T @ (each * (p - label))
            total[1:] += (x * (each * p * (1 - p))[:, None]).T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(s.as_py()) for batch in batches for s in batch.column("sums"))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = map_arrow(map_arrow(pool, run, "sums binary").repartition(SUMS), add, "sums binary").collect()
    total = sum((np.frombuffer(r.sums) for r in parts), np.zeros((size + 1) * size)).reshape(size + 1, size)
    return total[0], total[1:]


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, pool: DataFrame, rounds: int = 3, certain: float = 0.95) -> Model:
    """Exchange pseudo-labels of all of the pool for some rounds, calibrate on the held-out rows, combine."""
    (xt, known), (xm, _) = [(v[~held], y[~held]) for v in views]
    weights, history = [fit_logistic(x, known) for x in (xt, xm)], [[], []]
    for _ in range(rounds):
        for past, w in zip(history, weights):
            past.append(w)
        counts = pseudo_counts(pool, history, certain)
        each = [[min(1.0, SHARE * len(known) / max(1, counts.n[(counts["view"] == v) & (counts.label == label)].sum())) for label in (0, 1)] for v in (0, 1)]
        told = counts[counts["view"] == 0]
        x, label = np.vstack([xm, cell_features(told.cell.to_numpy())]), np.append(known, told.label.to_numpy(float))
        mass = np.append(np.ones(len(known)), told.n.to_numpy(float) * np.array(each[0])[told.label.to_numpy()])
        meta = fit_logistic(x, label, weight=mass)
        some = (counts["view"] == 1).any()
        text = fit_logistic(xt, known, start=weights[0], more=(lambda w: newton_sums(pool, history, certain, tuple(each[1]), w)) if some else None)
        weights = [text, meta]
    logits = [_logit(v[held], w) for v, w in zip(views, weights)]
    scales = [fit_logistic(z[:, None], y[held], 0.01) for z in logits]
    both = fit_logistic(np.column_stack([_logit(z[:, None], s) for z, s in zip(logits, scales)]), y[held], 0.01)
    return Model(*weights, *scales, both)


def _features(part: pa.RecordBatch, text_col: str, meta: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    texts = [(t or "").encode() for t in part.column(text_col).to_pylist()]
    return text_features(texts), meta_features(*(part.column(c).to_pylist() for c in meta))


def _small(batch: pa.RecordBatch, text_col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about so many bytes of text."""
    column = batch.column(text_col)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if column.type == pa.large_string() else np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str, str] = ("source", "lang", "n_chars"), label_col: str = "quality") -> Model | None:
    """Fit the model; None if the labelled sample lacks a kind of label.

    Labelled rows without a document, an id or a label are left out; documents that repeat
    an id count each, ``max_labelled`` of all at most. All documents that no label names are the pool, with those without an id.
    """
    key = F.md5(F.col("_id").cast("string"))
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null").orderBy(key, "_y").limit(max_labelled)
    known = labels.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(meta)])
    rows = texts.join(F.broadcast(wanted), "_id")  # max_labelled rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, "_text"):
                xt, xm = _features(part, "_text", ("_m0", "_m1", "_m2"))
                held = [zlib.crc32(str(i).encode()) % 3 == 0 for i in part.column("_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), part.column("_y"), pa.array(held), pa.array(list(np.column_stack([xt, xm]).astype(np.float32)), pa.list_(pa.float32()))], ["i", "y", "held", "x"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, "_text"):
                xt, xm = _features(part, "_text", ("_m0", "_m1", "_m2"))
                flat = pa.array(xt.astype(np.float32).ravel())
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(xt) + 1, dtype=np.int32) * TEXT_DIMS), flat)
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.int64()), x, pa.array(cells_of(xm))], ["_id", "x", "cell"])

    measured = map_arrow(rows, run, "i long, y double, held boolean, x array<float>")
    measured = measured.orderBy(F.md5(F.col("i").cast("string")), "y", "x").limit(max_labelled)  # documents can repeat an id
    found: pd.DataFrame = measured.toPandas().sort_values("i", kind="stable")
    if not len(found):
        return None
    x = np.array(found["x"].tolist(), np.float64)
    y, held = found["y"].to_numpy(), found["held"].to_numpy(bool)
    parts = [(y > 0.5)[held == h] for h in (False, True)]
    if any(len(p) == 0 or p.all() or not p.any() for p in parts):
        return None
    pool = cut(map_arrow(texts, measure, "_id long, x array<float>, cell int").join(known, "_id", "left_anti").select("x", "cell"))
    return co_train([x[:, :TEXT_DIMS], x[:, TEXT_DIMS:]], (y > 0.5).astype(float), held, pool)


SCORES = (("text_score", "double"), ("meta_score", "double"), ("score", "double"))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", meta: tuple[str, str, str] = ("source", "lang", "n_chars"), threshold: float = 0.5) -> DataFrame:
    """All rows and columns with ``text_score, meta_score, score, kept``; like-named columns are replaced.

    Null and empty texts are scored as empty ones. Without a model (no labels) scores are null
    and everything is kept. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("kept", *(s for s, _ in SCORES))]
    rows = docs.select(*names)
    if model is None:
        return rows.select("*", *[F.lit(None).cast(t).alias(s) for s, t in SCORES], F.lit(True).alias("kept"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(s, T.DoubleType()) for s, _ in SCORES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, model.scores(*_features(part, text_col, meta)))], [*part.schema.names, *(s for s, _ in SCORES)])

    return map_arrow(rows, run, schema).withColumn("kept", F.col("score") >= threshold)
