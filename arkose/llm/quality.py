"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of 64 words). Every passage is described by
counts of its bytes' classes, of pairs of coarser classes, and of its words' lengths and
repeats, and encoded by a small learned layer. A gated attention network weighs the
passages; only the documents' labels train it. The weighted representation is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import mapped, settled, slices, typed
from arkose.shipping import shipped

PASSAGE_WORDS = 64
#: Bounds of what is fitted on: labelled documents (least hashes of their ids first) and
#: their passages together; of each document that is taken, all passages.
TRAIN_DOCS, TRAIN_PASSAGES = 4096, 131_072
#: Longer texts are read in pieces of about so many bytes, cut between passages.
PIECE = 1 << 20
LAGS = (1, 2, 3, 4)
HIDDEN, GATES = 16, 8
#: Steps of the fit, each over so many documents, whatever the number of rows.
STEPS, BATCH = 2500, 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Byte to class, and class to coarse class: space, line end, vowel, other small
    letter, capital, digit, beyond ASCII, control, marks (32 classes, one coarse)."""
    fine, coarse = np.zeros(256, np.uint8), [0, 1, 2, 3, 4, 5, 6, 7]
    for b in range(256):
        c = chr(b)
        if b in (10, 13):
            fine[b] = 1
        elif _SPACE[b]:
            fine[b] = 0
        elif b >= 128:
            fine[b] = 6
        elif c in "aeiou":
            fine[b] = 2
        elif c.islower():
            fine[b] = 3
        elif c.isupper():
            fine[b] = 4
        elif c.isdigit():
            fine[b] = 5
        elif b < 32 or b == 127:
            fine[b] = 7
        else:
            fine[b] = len(coarse)
            coarse.append(8)
    return fine, np.array(coarse, np.uint8)


FINE, COARSE = _classes()
N_FINE, N_COARSE = len(COARSE), int(COARSE.max()) + 1
_COARSE_OF_BYTE = COARSE[FINE]
N_FEATURES = N_FINE + N_COARSE * N_COARSE + len(LAGS) + 3
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _pieces(data: bytes):
    """A text's bytes in pieces of whole passages, of at most PIECE bytes unless one passage
    is longer, so that the pieces' passages are the text's."""
    at, size = 0, PIECE
    while len(data) - at > size:
        space = _SPACE[np.frombuffer(data, np.uint8, size, at)]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        whole = (len(starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
        if whole <= 0:
            size *= 2
            continue
        yield data[at : at + starts[whole]]
        at, size = at + int(starts[whole]), PIECE
    yield data[at:]


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of passages of each text); a text without words has one passage
    with the features 0."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    inner = ~space
    starts = np.flatnonzero(inner & np.r_[True, space[:-1]])
    text_of = np.searchsorted(ends, starts, "right")
    words = np.bincount(text_of, minlength=len(texts))
    counts = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), N_FEATURES), np.float32)
    if not len(starts):
        return out, counts
    first = np.cumsum(words) - words
    word_passage = base[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE_WORDS
    # A byte belongs to the passage of the word at or before it, within its text.
    last_start = np.r_[starts, len(raw)]
    span = np.diff(last_start)
    of = np.repeat(word_passage.astype(np.int32), span)
    body = raw[starts[0] :]
    keep = np.repeat(ends[text_of] - 1, span) > np.arange(starts[0], len(raw))  # not what joins the texts
    fine = FINE[body]
    n = np.maximum(1, np.bincount(of[keep], minlength=len(out)))[:, None]
    out[:, :N_FINE] = np.bincount((of * N_FINE + fine)[keep], minlength=len(out) * N_FINE).reshape(-1, N_FINE) / n
    rough = COARSE[fine]
    pair = keep[:-1] & keep[1:] & (of[:-1] == of[1:])
    code = ((of[:-1] * N_COARSE + rough[:-1]) * N_COARSE + rough[1:])[pair]
    out[:, N_FINE : N_FINE + N_COARSE**2] = np.bincount(code, minlength=len(out) * N_COARSE**2).reshape(-1, N_COARSE**2) / n
    at = np.arange(len(body)) - np.repeat(starts - starts[0], span)
    terms = np.where(inner[starts[0] :], (body.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 63], np.uint64(0))
    key = np.add.reduceat(terms, starts - starts[0])
    length = np.add.reduceat(inner[starts[0] :].astype(np.int64), starts - starts[0])
    n_words = np.maximum(1, np.bincount(word_passage, minlength=len(out)))
    col = N_FINE + N_COARSE**2
    for i, lag in enumerate(LAGS):
        same = (key[lag:] == key[:-lag]) & (word_passage[lag:] == word_passage[:-lag])
        out[:, col + i] = np.bincount(word_passage[lag:][same], minlength=len(out)) / n_words
    col += len(LAGS)
    mean = np.bincount(word_passage, length, minlength=len(out)) / n_words
    out[:, col] = np.minimum(mean, 40) / 10
    out[:, col + 1] = np.bincount(word_passage, np.minimum(length, 40) ** 2, minlength=len(out)) / n_words / 100
    out[:, col + 2] = np.log1p(np.bincount(word_passage, minlength=len(out))) / 4
    return out, counts


def bags(texts: list[str | None]):
    """The passages' features of each text in turn, in bounded memory."""
    group: list[bytes] = []
    whose: list[int] = []
    size, parts, done = 0, [], 0

    def solved():
        features, counts = passages(group)
        return zip(whose, np.split(features, np.cumsum(counts)[:-1]))  # a piece has a word, unless it is its text

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").encode()):
            group.append(piece)
            whose.append(i)
            size += len(piece)
            if size >= PIECE:
                for owner, f in solved():
                    if owner != done:
                        yield np.concatenate(parts)
                        parts, done = [], owner
                    parts.append(f)
                group, whose, size = [], [], 0
    if group:
        for owner, f in solved():
            if owner != done:
                yield np.concatenate(parts)
                parts, done = [], owner
            parts.append(f)
    if parts:
        yield np.concatenate(parts)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by name; `prior` alone (no weights) scores every text the same."""

    prior: float
    weights: dict | None = None

    def score(self, x: np.ndarray) -> float:
        """Of a text's passages (features in rows)."""
        if self.weights is None:
            return self.prior
        w = self.weights
        x = np.clip((x - w["mean"]) / w["std"], -10, 10)
        h = np.tanh(x @ w["W"] + w["b"])
        logit = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]
        a = np.exp(logit - logit.max())
        return float(_sigmoid((a / a.sum()) @ h @ w["c"] + w["c0"]))


def loss_and_gradients(w: dict, x: np.ndarray, n: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, dict]:
    """The mean log loss of bags (their passages in runs of n rows of x) with labels y, and
    half the squared weights W and c times the decay; and its gradients by weight."""
    heads = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    h = np.tanh(x @ w["W"] + w["b"])
    tv, su = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (tv * su) @ w["a"]
    e = np.exp(logit - np.maximum.reduceat(logit, heads)[of])
    a = e / np.add.reduceat(e, heads)[of]
    z = np.add.reduceat(a[:, None] * h, heads)
    p = _sigmoid(z @ w["c"] + w["c0"])
    loss = -np.mean(np.log(np.where(y > 0, p, 1 - p))) + decay / 2 * ((w["W"] ** 2).sum() + (w["c"] ** 2).sum())
    err = (p - y) / len(n)
    dz = err[:, None] * w["c"]
    along = (dz[of] * h).sum(1)
    dlogit = a * (along - np.add.reduceat(a * along, heads)[of])
    dg = dlogit[:, None] * w["a"]
    dv, du = dg * su * (1 - tv * tv), dg * tv * su * (1 - su)
    dh = a[:, None] * dz[of] + dv @ w["V"].T + du @ w["U"].T
    dp = dh * (1 - h * h)
    return float(loss), {"W": x.T @ dp + decay * w["W"], "b": dp.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (tv * su).T @ dlogit, "c": z.T @ err + decay * w["c"], "c0": err.sum()}


def first_weights(rng: np.random.Generator, prior: float) -> dict:
    return {"W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "a": rng.normal(0, GATES**-0.5, GATES), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.array(np.log(prior / (1 - prior)))}


def fit(bag_list: list[np.ndarray], labels, steps: int = STEPS, seed: int = 7, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Trains on bags and labels 0 / 1 by Adam on the log loss. With one class only (or
    no bag) the model is the smoothed share of label 1."""
    y_all = np.asarray(labels, np.float64)
    prior = float((y_all.sum() + 1) / (len(y_all) + 2))
    if len(set(y_all.tolist())) < 2:
        return Model(prior)
    rng = np.random.default_rng(seed)
    x_all = np.concatenate(bag_list).astype(np.float64)
    mean, std = x_all.mean(0), x_all.std(0)
    std = np.where(std < 1e-4, 1.0, std)
    x_all = np.clip((x_all - mean) / std, -10, 10)
    counts = np.array([len(b) for b in bag_list])
    base = np.cumsum(counts) - counts
    w = first_weights(rng, prior)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    order = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(counts))
        docs, order = order[:BATCH], order[BATCH:]
        rows = np.concatenate([np.arange(base[d], base[d] + counts[d]) for d in docs])
        _, grads = loss_and_gradients(w, x_all[rows], counts[docs], y_all[docs], decay)
        for k, g in grads.items():
            m, v = moment[k]
            moment[k] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w[k] = w[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(prior, w | {"mean": mean, "std": std})


def held_out(id_col="doc_id"):
    """Rows whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@shipped
def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from a bounded sample of the labelled rows that are not held out.

    Null labels and ids are left out, and ids without a row in `df`; several labels of an
    id count as their least; a null text counts as empty. Sampled are the TRAIN_DOCS ids
    of least hash; of their rows (ids may repeat), in the order of the hash, at most
    TRAIN_DOCS, and each only if the passages taken so far and its own are no more than
    TRAIN_PASSAGES. A row that is taken is fitted with all its passages, however long.
    Without rows or labels, or with labels of one kind, the model has no weights.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    named = named.where(~held_out("id")).groupBy("id").agg(F.min("y").cast("int").alias("y"))
    there = df.select(F.col(id_col).alias("there"))
    named = named.join(there, F.col("id") == F.col("there"), "left_semi")
    named = named.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)  # so small enough to broadcast

    def run(batches):
        for batch in slices(batches):
            found = list(bags(batch.column(1).to_pylist()))
            x = [f.astype("<f4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(len, found), pa.int32()), pa.array(x, pa.binary())], names=["id", "y", "n", "x"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(named), "id").select("id", "text", "y")
    rows = settled(docs.mapInArrow(run, typed(docs, "id", "y int, n int, x binary")))
    keys = rows.select("n", F.xxhash64("id").alias("a"), "id", F.xxhash64("x").alias("b")).orderBy("a", "id", "b").limit(TRAIN_DOCS).select("n", "a", "b").collect()
    taken, left = [], TRAIN_PASSAGES
    for r in keys:
        if r.n <= left:
            taken.append((r.a, r.b))
            left -= r.n
    if not taken:
        return fit([], [])
    chosen = df.sparkSession.createDataFrame(taken, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("times"))
    rows = rows.withColumns({"a": F.xxhash64("id"), "b": F.xxhash64("x")}).join(F.broadcast(chosen), ["a", "b"])
    # Repeated rows are equal, so any `times` of them are those that were taken.
    found, seen = [], {}
    for r in rows.orderBy("a", "id", "b").limit(2 * TRAIN_DOCS).collect():
        seen[r.a, r.b] = seen.get((r.a, r.b), 0) + 1
        if seen[r.a, r.b] <= r.times:
            found.append(r)
    return fit([np.frombuffer(bytes(r.x), "<f4").reshape(-1, N_FEATURES) for r in found], [int(r.y > 0) for r in found])


@shipped
def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1, higher: label 1 likelier), from the whole text,
    however long.

    A null or empty text is one empty passage; a null id is kept; repeated rows give
    equal scores; an empty table gives no row; other columns are ignored. A model without
    weights gives every text its prior.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(x) for x in bags(batch.column(1).to_pylist())], pa.float64())], names=["id", "score"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, typed(source, "id", "score double")).withColumnRenamed("id", id_col)


@shipped
def accepted(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all its columns of any name, whose score is the threshold or
    more (a score equal to it is accepted).

    A null or empty text is scored as one empty passage; texts are scored whole, however
    long; repeated rows stay or go together; an empty table gives no row. A model without
    weights (no labels, or of one kind only) tells no text from another: all rows stay.
    """
    if model.weights is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, at):
            keep = [shared.value.score(x) >= threshold for x in bags(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(df, run, df.schema)
