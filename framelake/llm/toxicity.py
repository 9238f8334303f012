"""A convolutional text classifier of toxicity, trained in numpy.

Words are hashed into a table of embeddings, together with their prefixes of a few lengths, so that words never
seen share what their beginnings taught. Filters of several widths run over the words; their outputs are max
pooled over stretches of STRETCH words. A text's features are the largest and the mean of its stretches, and a
logistic layer makes a score of them, calibrated by cross-fitting: on the scores that all labelled rows get from models
that have not seen them. Each language gets a threshold of its own from those scores; language, source, labels and ids are never inputs of a score.

trained() learns from every labelled row that is not held out, whole; equal rows count once. Rows are dealt by their id's hash into
parts of about PART_BYTES, where their labels meet them. In each round every part takes all models some steps further in a task of its own, and the
parts' models are averaged in Spark: table rows over the parts that changed them, the rest by the rows seen. Rows of up
to ALONE_BYTES together are learned by train() at once. fitted() makes a quick model of a bounded sample: of class c at most
SAMPLE[c] rows, by smallest hash, as far as their texts fit into SAMPLE_CHARS[c] together; no query uses it. Scoring
reads whole texts.
A language's threshold is drawn to that of all rows by as much as PRIOR_TOXIC toxic rows weigh, and that to EVEN, so few
toxic rows say little; null is a language. Null and wordless texts get the score of a text without features; unlabelled tables give
the constant 0.1 as score. Repeated rows are scored each; an empty table gives an empty result; columns of any names
are kept.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.arrowtext import Rolling, buffers, folded, slices, words
from framelake.llm.rows import unused
from framelake.session import folder_of, forget, staged

BUCKETS, WIDTH = 1 << 16, 8
#: Bytes of the hashed prefixes; a shorter word counts as its own prefix.
PREFIXES = (4, 5, 6, 7)
FILTERS = {1: 8, 2: 4, 3: 4}
STRETCH = 64
SAMPLE = {0: 4000, 1: 2000}
SAMPLE_CHARS = {0: 16 << 20, 1: 8 << 20}
#: Sampled texts tokenised at once, on the driver.
TEXTS_AT_ONCE = 32
#: Epochs show the sample VISITS times in all, within these bounds.
VISITS, EPOCHS, BATCH, RATE = 50_000, (4, 30), 64, 0.02
THRESHOLD = 0.3
#: Toxic rows that the threshold of all rows counts as against a language's own, and the folds of the calibration.
PRIOR_TOXIC, FOLDS = 10, 3
#: What the threshold of all rows is drawn to in turn: the score at which a calibrated model finds both labels alike.
EVEN = 0.5
#: For calibrated scores the best threshold is F0.5 / 1.25, so under 0.2 only where nothing reaches an F0.5 of 0.25.
LEAST_THRESHOLD, MOST_THRESHOLD = 0.2, 0.95
GAP = max(FILTERS) - 1
#: Text bytes learned by one task in a round, and up to which all rows are learned at once, a row counting as ROW_BYTES more.
PART_BYTES, ALONE_BYTES, ROW_BYTES = 32 << 20, 8 << 20, 64
#: Rows of the table that are averaged together.
BLOCK = 1024
#: Words of the filter of labelled ids.
WORDS = 1 << 20
#: Logits that calibrate are rounded to 1 / BINS, for models of many parts.
BINS = 64


def held_out() -> Column:
    """The rows that labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@dataclass
class Tokens:
    """Words of many texts as rows of bucket numbers, GAP empty rows (bucket 0) after each stretch's text end."""

    ids: np.ndarray
    #: First token and text of each stretch; texts without words have none.
    starts: np.ndarray
    owner: np.ndarray
    texts: int

    @property
    def empty(self) -> np.ndarray:
        """Which of the rows that filters start at are no words."""
        return self.ids[: len(self.ids) - GAP, 0] == 0


def tokenised(data: np.ndarray, at: np.ndarray) -> Tokens:
    data = folded(data)
    lo, hi, row = words(data, at)
    roll = Rolling(data)
    each = [roll.of(lo, hi)] + [roll.of(lo, np.minimum(lo + p, hi)) + np.uint64(p) for p in PREFIXES]
    buckets = [(h % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.uint16) for h in each]
    n = len(at) - 1
    place = np.arange(len(lo)) + GAP * row
    ids = np.zeros((len(lo) + GAP * n + GAP, len(buckets)), np.uint16)
    for k, b in enumerate(buckets):
        ids[place, k] = b
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) + GAP * np.arange(n)
    pieces = -(-count // STRETCH)
    owner = np.repeat(np.arange(n), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return Tokens(ids, first[owner] + within * STRETCH, owner, n)


@dataclass
class Model:
    table: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = EVEN
    #: Of languages that have one of their own; null and the empty string are languages.
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        x = self.table.take(ids[:, 0], axis=0)
        for k in range(1, ids.shape[1]):
            x += self.table.take(ids[:, k], axis=0)
        return x

    def pooled(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The filters' max over each stretch (stretches x filters), and the tokens' embeddings."""
        x, empty = self.embedded(t.ids), t.empty
        maps = []
        for w, kernel in self.kernels.items():
            y = x[: len(x) - GAP] @ kernel[0]
            for o in range(1, w):
                y += x[o : len(x) - GAP + o] @ kernel[o]
            y[empty] = 0  # from there a filter would see the next text
            maps.append(np.maximum(np.maximum.reduceat(y, t.starts, axis=0) + self.biases[w], 0) if len(t.starts) else np.zeros((0, kernel.shape[2]), np.float32))
        return np.concatenate(maps, axis=1), x

    def features(self, pooled: np.ndarray, t: Tokens) -> np.ndarray:
        n, f = t.texts, pooled.shape[1]
        top, mean = np.zeros((n, f), np.float32), np.zeros((n, f), np.float32)
        if len(t.owner):
            have, first, count = np.unique(t.owner, return_index=True, return_counts=True)
            top[have] = np.maximum.reduceat(pooled, first, axis=0)
            mean[have] = np.add.reduceat(pooled, first, axis=0) / count[:, None]
        return np.concatenate([top, mean], axis=1)

    def logits(self, t: Tokens) -> np.ndarray:
        return self.features(self.pooled(t)[0], t) @ self.out + self.bias

    def scores(self, t: Tokens) -> np.ndarray:
        z = self.scale[0] * self.logits(t).astype(np.float64) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _batch(ids: np.ndarray, rows: np.ndarray, span: np.ndarray) -> Tokens:
    """The texts in rows as Tokens of their own. span: [first, last) row of ids of each text."""
    parts = [ids[a:b] for a, b in span[rows]]
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    counts = np.maximum(0, sizes - GAP)
    pieces = -(-counts // STRETCH)
    owner = np.repeat(np.arange(len(rows)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return Tokens(np.concatenate([*parts, np.zeros((GAP, ids.shape[1]), np.uint16)]), first[owner] + within * STRETCH, owner, len(rows))


def _fresh(rng: np.random.Generator) -> Model:
    f = sum(FILTERS.values())
    return Model(
        np.concatenate([np.zeros((1, WIDTH)), rng.normal(0, 0.05, (BUCKETS - 1, WIDTH))]).astype(np.float32),
        {w: rng.normal(0, 0.5, (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS.items()},
        {w: np.zeros(n, np.float32) for w, n in FILTERS.items()},
        rng.normal(0, 0.3, 2 * f).astype(np.float32),
        0.0,
    )


def _spans(parts: list[Tokens]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all parts, and [first, last) row of each text."""
    counts = np.concatenate([_lengths(t) for t in parts])
    ids = np.concatenate([t.ids[: len(t.ids) - GAP] for t in parts])
    first = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]])
    return ids, np.stack([first, first + counts + GAP], axis=1)


def _learned(ids: np.ndarray, span: np.ndarray, labels: np.ndarray, weights: np.ndarray, seen: np.ndarray, rng: np.random.Generator) -> Model:
    """A model that has seen the rows seen, not calibrated yet."""
    model = _fresh(rng)
    state = {"m": {}, "v": {}, "n": 0}
    epochs = int(np.clip(VISITS // max(1, len(seen)), *EPOCHS))
    for epoch in range(epochs):
        order = rng.permutation(seen)
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            _step(model, _batch(ids, rows, span), labels[rows].astype(np.float32), (weights[rows] ** 0.5).astype(np.float32), rate, state)
    return model


def _part(texts: list[str], labels: np.ndarray, weights: np.ndarray, fold: int, seed: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """(model, rows, logits): a model of the rows outside a fold, and what it says about those inside; fold FOLDS is empty."""
    ids, span = _spans([tokenised(*buffers(pa.array(texts[lo : lo + TEXTS_AT_ONCE], pa.string()))) for lo in range(0, len(texts), TEXTS_AT_ONCE)])
    rng, folds = np.random.default_rng(seed), np.zeros(len(texts), int)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == c))
        folds[own] = np.arange(len(own)) % FOLDS
    unseen = np.flatnonzero(folds == fold)
    model = _learned(ids, span, labels, weights, np.flatnonzero(folds != fold), np.random.default_rng([seed, fold]))
    z = [model.logits(_batch(ids, unseen[lo : lo + BATCH], span)) for lo in range(0, len(unseen), BATCH)]
    return model, unseen, np.concatenate(z) if z else np.zeros(0)


def _in_tasks(spark: SparkSession) -> Callable:
    """Like map, but each call is a task of its own."""

    def run(call: Callable, over: range) -> list:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(call(k))])], ["id", "out"])

        rows = spark.range(over.start, over.stop, 1, len(over)).mapInArrow(one, "id long, out binary").collect()  # a model each
        return [pickle.loads(r.out) for r in sorted(rows, key=lambda r: r.id)]

    return run


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], weights: np.ndarray, seed: int = 5, run: Callable = map) -> Model:
    """weights: how many labelled rows each row stands for.

    The model learns from all rows; its scale and thresholds come from the scores that each row gets from a model of
    the other folds. run calls a function for each model to be trained.
    """
    *folds, (model, _, _) = run(partial(_part, texts, labels, weights, seed=seed), range(FOLDS + 1))
    z = np.zeros(len(texts))
    for _, unseen, logits in folds:
        z[unseen] = logits
    model.scale = _calibrated(z, labels, weights)
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -40, 40)))
    model.threshold = _drawn(_threshold(p, labels * weights, weights), labels.sum(), EVEN)
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        if labels[own].any():
            model.thresholds[lang] = _drawn(_threshold(p[own], (labels * weights)[own], weights[own]), labels[own].sum(), model.threshold)
    return model


def _drawn(threshold: float, toxic: int, to: float) -> float:
    return float((toxic * threshold + PRIOR_TOXIC * to) / (toxic + PRIOR_TOXIC))


def _step(model: Model, t: Tokens, y: np.ndarray, weight: np.ndarray, rate: float, state: dict) -> None:
    """One step of Adam on the weighted log loss; the max lets gradients through at one token of each stretch only."""
    x = model.embedded(t.ids)
    ends = np.append(t.starts[1:], len(x) - GAP) if len(t.starts) else t.starts
    spots = np.minimum(t.starts[:, None] + np.arange(STRETCH), np.minimum(t.starts + STRETCH, ends)[:, None] - 1)
    pooled, where, empty = [], {}, t.empty
    for w, kernel in model.kernels.items():
        out = sum(x[o : len(x) - GAP + o] @ kernel[o] for o in range(w))
        out[empty] = 0
        best = where[w] = spots[:, :1] + out[spots].argmax(axis=1)
        pooled.append(np.maximum(np.take_along_axis(out, best, axis=0) + model.biases[w], 0))
    pooled = np.concatenate(pooled, axis=1)
    features = model.features(pooled, t)
    p = 1 / (1 + np.exp(-np.clip(features @ model.out + model.bias, -30, 30)))
    dz = (p - y) * weight / weight.sum()
    grads: dict = {"out": features.T @ dz, "bias": dz.sum()}
    f = pooled.shape[1]
    dtop, dmean = dz[:, None] * model.out[None, :f], dz[:, None] * model.out[None, f:]
    pieces = np.bincount(t.owner, minlength=t.texts)
    d = dmean[t.owner] / pieces[t.owner][:, None]
    d += dtop[t.owner] * (pooled >= features[t.owner, :f]) * (pooled > 0)
    d *= pooled > 0
    touched, pushes, at = [], [], 0
    for w, kernel in model.kernels.items():
        n = kernel.shape[2]
        g, best = d[:, at : at + n], where[w]
        at += n
        grads[f"b{w}"] = g.sum(axis=0)
        g = g * ~empty[best]
        dk = np.zeros_like(kernel)
        for o in range(w):
            for j in range(n):
                dk[o, :, j] = g[:, j] @ x[best[:, j] + o]
                live = np.flatnonzero(g[:, j])
                touched.append(best[live, j] + o)
                pushes.append(g[live, j, None] * kernel[o, :, j])
        grads[f"k{w}"] = dk
    state["n"] += 1
    for name, g in grads.items():
        _adam(model, name, g, rate, state)
    if touched and sum(map(len, touched)):
        ids, push = t.ids[np.concatenate(touched)], np.concatenate(pushes)
        flat = ids.ravel()
        keep = flat > 0
        rows, back = np.unique(flat[keep], return_inverse=True)
        total = np.zeros((len(rows), WIDTH), np.float32)
        push = np.repeat(push, ids.shape[1], axis=0)[keep]
        for e in range(WIDTH):
            total[:, e] = np.bincount(back, push[:, e], len(rows))
        v = state["v"].setdefault("table", np.zeros(len(model.table), np.float32))
        v[rows] += (total**2).mean(axis=1)
        model.table[rows] -= 0.1 * (rate / RATE) * total / np.sqrt(v[rows] + 1e-10)[:, None]


def _adam(model: Model, name: str, g, rate: float, state: dict) -> None:
    m = state["m"][name] = 0.9 * state["m"].get(name, 0) + 0.1 * g
    v = state["v"][name] = 0.99 * state["v"].get(name, 0) + 0.01 * g**2
    step = rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(v / (1 - 0.99 ** state["n"])) + 1e-8)
    if name == "out":
        model.out -= step.astype(np.float32)
    elif name == "bias":
        model.bias -= float(step)
    elif name[0] == "k":
        model.kernels[int(name[1:])] -= step.astype(np.float32)
    else:
        model.biases[int(name[1:])] -= step.astype(np.float32)


def _lengths(t: Tokens) -> np.ndarray:
    """Words of each text, from the empty rows that end it."""
    ends = np.flatnonzero(t.ids[:, 0] == 0)[: GAP * t.texts : GAP] if GAP else np.zeros(0, np.int64)
    return np.diff(np.concatenate([[-GAP], ends])) - GAP


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's a, b by Newton steps on scores of unseen rows."""
    a, b = 1.0, 0.0
    if len(set(y)) < 2:
        return a, b
    x = np.stack([z, np.ones_like(z)], axis=1)
    prior = np.diag([0.05, 0.001]) * weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = x.T @ (weight * (p - y)) + prior @ [a - 1, b]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + prior
        da, db = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -2, 2)
    return float(a), float(b)


def _threshold(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The score that parts the classes with the best F0.5: a clean document lost weighs more than a toxic one kept.

    toxic: how much of the weight of each entry is toxic.
    """
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum(toxic[order]), np.cumsum(weight[order])
    f = 1.25 * hit / (all_ + 0.25 * toxic.sum())
    best = int(f.argmax())
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order][best] + below) / 2, LEAST_THRESHOLD, MOST_THRESHOLD))


def _learnable(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trained on all labelled rows that are not held out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", text).alias("mark"))
    own, key = _learnable(labels), ["part", "mark", "doc_id", "lang", "toxic"]
    texts = _marked(texts.where(F.col("doc_id").isNotNull()), own)
    size = texts.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    parts = 1 if size <= ALONE_BYTES else max(2, -(-size // PART_BYTES))
    rows = _dealt(texts, own, parts).dropDuplicates(key).sortWithinPartitions(*key)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int")  # equal texts share one
    held = staged(rows.select("part", fold.alias("fold"), "doc_id", F.col("toxic").cast("int").alias("toxic"), "lang", "text"), "labelled")
    per = {r.toxic: r.n for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(per) < 2:
        model = None
    elif parts == 1:
        some = sorted(held.collect(), key=lambda r: (r.doc_id, r.text, r.toxic, r.lang is None, r.lang))
        model = train([r.text for r in some], np.array([r.toxic for r in some]), [r.lang for r in some], np.ones(len(some)), run=_in_tasks(docs.sparkSession))
    else:
        model = _in_parts(held, int(np.clip(VISITS // sum(per.values()), *EPOCHS)))
    forget(docs.sparkSession, folder_of(held))
    return model


def _marked(texts: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id may be in own: all that are, few that are not, so that few texts are dealt.

    At most WORDS words of 64 bits, one bit for each hash of a doc_id, are sent to the tasks.
    """

    def place(at: str) -> Column:
        return F.expr(f"pmod(xxhash64(doc_id) >> 6, {WORDS}L) AS {at}")

    bit = F.xxhash64("doc_id").bitwiseAND(F.lit(63)).cast("int")
    words = own.select(place("word_of_id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("word_of_id").agg(F.bit_or("b").alias("bits_of_ids"))
    met = texts.select("*", place("word_of_id")).join(F.broadcast(words), "word_of_id")
    return met.where(F.call_function("shiftrightunsigned", F.col("bits_of_ids"), bit).bitwiseAND(F.lit(1)) == 1).select(*texts.columns)


def _dealt(texts: DataFrame, own: DataFrame, parts: int) -> DataFrame:
    """The rows of texts with part and toxic, once for each label of their doc_id.

    Labels go to the part of their doc_id, so texts are shuffled once, not for a join and then again into parts.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    both = texts.unionByName(own, allowMissingColumns=True).withColumn("part", part).repartition(2 * parts, "part")
    met = both.withColumn("toxic", F.collect_set("toxic").over(Window.partitionBy("part", "doc_id")))
    return met.where(F.col("text").isNotNull()).withColumn("toxic", F.explode("toxic"))


def _in_parts(held: DataFrame, rounds: int) -> Model:
    learners = [(_fresh(np.random.default_rng([5, k])), {"m": {}, "v": {}, "n": 0}) for k in range(FOLDS + 1)]
    for k in range(rounds):
        learners = _further(held, learners, RATE * (1 - k / rounds), k)
    return _with_thresholds(held, [m for m, _ in learners])


def _dense(model: Model, state: dict) -> np.ndarray:
    """All of a model and its optimizer but the table, in one array."""
    own = _arrays(model)
    return np.concatenate([np.ravel(x) for x in own.values()] + [np.ravel(state[s].get(name, np.zeros_like(x))) for s in "mv" for name, x in own.items()]).astype(np.float64)


def _arrays(model: Model) -> dict[str, np.ndarray]:
    return {"out": model.out, "bias": np.array(model.bias), **{f"b{w}": x for w, x in model.biases.items()}, **{f"k{w}": x for w, x in model.kernels.items()}}


def _set_dense(model: Model, state: dict, flat: np.ndarray) -> None:
    at = 0
    for s in ("", "m", "v"):
        for name, x in _arrays(model).items():
            new = flat[at : at + x.size].reshape(x.shape)
            at += x.size
            if s:
                state[s][name] = new
            elif name == "bias":
                model.bias = float(new)
            elif name == "out":
                model.out = new.astype(np.float32)
            else:
                {"b": model.biases, "k": model.kernels}[name[0]][int(name[1:])] = new.astype(np.float32)


def _gradients(state: dict) -> np.ndarray:
    """Squared gradients of the table's rows so far."""
    return state["v"].get("table", np.zeros(BUCKETS, np.float32))


_CHANGES = "model int, block int, part int, weight long, steps int, data binary"


def _changed(part: int, old: list[tuple[Model, dict]], new: list[tuple[Model, dict]], seen: list[int]) -> pa.RecordBatch:
    """What a part has made of the models: rows of the table that it changed, by blocks, and block -1 with all else."""
    out = []
    for k, ((a, before), (b, after)) in enumerate(zip(old, new, strict=True)):
        if not seen[k]:
            continue
        steps = after["n"] - before["n"]
        out.append((k, -1, part, seen[k], steps, _dense(b, after).tobytes()))
        rows = np.flatnonzero(_gradients(after) != _gradients(before)).astype(np.int32)
        change, squares = (b.table[rows] - a.table[rows]).astype(np.float16), (_gradients(after) - _gradients(before))[rows]
        for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows // BLOCK)) + 1):
            if len(own):
                out.append((k, int(rows[own[0]] // BLOCK), part, seen[k], steps, (rows[own] % BLOCK).astype(np.uint16).tobytes() + squares[own].tobytes() + change[own].tobytes()))
    names = ["model", "block", "part", "weight", "steps", "data"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each block of each model; rows come sorted by them."""
    at, total, weight, steps = None, None, None, 0

    def done() -> pa.RecordBatch:
        mean = total / (np.maximum(weight, 1)[:, None] if at[1] >= 0 else weight)
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((at[0], pa.int32()), (at[1], pa.int32()), (steps, pa.int32()), (mean.tobytes(), pa.binary()))], ["model", "block", "steps", "data"])

    for batch in batches:
        for r in batch.to_pylist():
            if at != (r["model"], r["block"]):
                if at:
                    yield done()
                at, steps = (r["model"], r["block"]), 0
                total, weight = (np.zeros((BLOCK, WIDTH + 1)), np.zeros(BLOCK)) if at[1] >= 0 else (0.0, 0)
            steps = max(steps, r["steps"])
            if at[1] < 0:
                total, weight = total + r["weight"] * np.frombuffer(r["data"]), weight + r["weight"]
                continue
            n = len(r["data"]) // (6 + 2 * WIDTH)
            rows = np.frombuffer(r["data"], np.uint16, n)
            total[rows, WIDTH] += np.frombuffer(r["data"], np.float32, n, offset=2 * n)
            total[rows, :WIDTH] += np.frombuffer(r["data"], np.float16, offset=6 * n).reshape(n, WIDTH)
            weight[rows] += 1
    if at:
        yield done()


def _further(held: DataFrame, learners: list[tuple[Model, dict]], rate: float, turn: int) -> list[tuple[Model, dict]]:
    """The models after one more round over all rows; model k sees no row of fold k."""
    shared = held.sparkSession.sparkContext.broadcast(learners)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, seen, rng = None, [], [], None
        for batch in slices(batches):
            parts = batch.column("part").to_numpy()
            for run in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                if part != parts[run[0]]:
                    if part is not None:
                        yield _changed(part, shared.value, own, seen)
                    part, own, seen = int(parts[run[0]]), copy.deepcopy(shared.value), [0] * len(shared.value)
                    rng = np.random.default_rng([turn, part])
                rows = batch.slice(run[0], len(run))
                ids, span = _spans([tokenised(*buffers(rows.column("text")))])
                fold, y = rows.column("fold").to_numpy(), rows.column("toxic").to_numpy().astype(np.float32)
                for k, (model, state) in enumerate(own):
                    order = rng.permutation(np.flatnonzero(fold != k))
                    seen[k] += len(order)
                    for some in np.array_split(order, max(1, round(len(order) / BATCH))) if len(order) else []:
                        _step(model, _batch(ids, some, span), y[some], np.ones(len(some), np.float32), rate, state)
        if part is not None:
            yield _changed(part, shared.value, own, seen)

    changes = held.select("part", "fold", "toxic", "text").mapInArrow(learn, _CHANGES)
    means = changes.repartition("model", "block").sortWithinPartitions("model", "block", "part").mapInArrow(_averaged, "model int, block int, steps int, data binary")
    out = copy.deepcopy(learners)
    for r in means.collect():  # as many rows as the models have blocks
        model, state = out[r.model]
        if r.block < 0:
            _set_dense(model, state, np.frombuffer(r.data))
            state["n"] += r.steps
        else:
            mean, at = np.frombuffer(r.data).reshape(BLOCK, WIDTH + 1).astype(np.float32), slice(r.block * BLOCK, (r.block + 1) * BLOCK)
            model.table[at] += mean[:, :WIDTH]
            state["v"]["table"] = _gradients(state)
            state["v"]["table"][at] += mean[:, WIDTH]
    shared.unpersist()
    return out


def _with_thresholds(held: DataFrame, models: list[Model]) -> Model:
    """The last of the models, calibrated on what each row gets from the one that has not seen it."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, span = _spans([tokenised(*buffers(batch.column("text")))])
            fold, z = batch.column("fold").to_numpy(), np.zeros(batch.num_rows)
            for k in range(FOLDS):
                own = np.flatnonzero(fold == k)
                for lo in range(0, len(own), BATCH):
                    z[own[lo : lo + BATCH]] = shared.value[k].logits(_batch(ids, own[lo : lo + BATCH], span))
            bins = np.rint(np.clip(z, -40, 40) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(bins)], ["lang", "toxic", "bin"])

    each = held.select("fold", "toxic", "lang", "text").mapInArrow(logits, "lang string, toxic int, bin int")
    bins = staged(each.groupBy("lang", "bin").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")), "bins")
    all_ = bins.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    model, z = models[-1], all_["bin"].to_numpy() / BINS
    toxic, n = all_["toxic"].to_numpy().astype(float), all_["n"].to_numpy().astype(float)
    model.scale = _calibrated(np.tile(z, 2), np.repeat([1, 0], len(z)), np.concatenate([toxic, n - toxic]))

    def scores(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -40, 40)))

    model.threshold = _drawn(_threshold(scores(z), toxic, n), toxic.sum(), EVEN)

    def of_language(own: pd.DataFrame) -> pd.DataFrame:
        toxic = own["toxic"].to_numpy().astype(float)
        least = _drawn(_threshold(scores(own["bin"].to_numpy() / BINS), toxic, own["n"].to_numpy().astype(float)), toxic.sum(), model.threshold)
        return pd.DataFrame({"lang": own["lang"].iloc[:1], "toxic": [int(toxic.sum())], "threshold": [least]})

    found = bins.groupBy("lang").applyInPandas(of_language, "lang string, toxic long, threshold double").where("toxic > 0")
    model.thresholds = {r.lang: r.threshold for r in found.collect()}
    forget(held.sparkSession, folder_of(bins))
    return model


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trained on a bounded sample of the labelled rows that are not held out."""
    own = _learnable(labels)
    per = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(per) < 2:
        return None
    picked = [own.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in SAMPLE.items()]
    sample = picked[0].unionByName(picked[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"), F.length(text).alias("chars"), F.xxhash64("doc_id", text).alias("mark"))
    some = staged(texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "mark", "toxic"]), "labelled")
    rows = []
    for c, n in SAMPLE.items():  # a doc_id may have many texts
        of_class = some.where((F.col("toxic") == c) & (F.col("chars") <= SAMPLE_CHARS[c]))
        room, chosen = SAMPLE_CHARS[c], []
        for r in of_class.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(n).select("doc_id", "mark", "chars").collect():
            if r.chars <= room:
                room -= r.chars
                chosen.append((r.doc_id, r.mark))
        if chosen:
            taken = docs.sparkSession.createDataFrame(chosen, some.select("doc_id", "mark").schema)
            rows += of_class.join(F.broadcast(taken), ["doc_id", "mark"], "left_semi").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    y = np.array([r.toxic for r in rows])
    if len(set(y)) < 2:
        return None
    weight = np.array([per[c] / max(1, (y == c).sum()) for c in y])
    return train([r.text for r in rows], y, [r.lang for r in rows], weight / weight.mean(), run=_in_tasks(docs.sparkSession))


def _judged(m: Model | None, texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score, rejected) of each text."""
    if m is None:
        return np.full(len(texts), 0.1), np.zeros(len(texts), bool)
    s = m.scores(tokenised(*buffers(texts)))
    return s, s >= np.array([m.thresholds.get(x, m.threshold) for x in langs.to_pylist()])


def _with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, then the text and its language, which are taken by place and named as no column of docs is."""
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(unused(docs, "text_of_row")), F.col("lang").cast("string").alias(unused(docs, "lang_of_row")))


def scored(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, score, and rejected: whether the score reaches the threshold of the row's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read, k = _with_text(docs, keep), len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, k):
            s, bad = _judged(shared.value, batch.column(k), batch.column(k + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(s), pa.array(bad)], [*keep, "score", "rejected"])

    schema = T.StructType([*read.schema.fields[:k], T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return read.mapInArrow(score, schema)


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that are rejected; its columns may have any names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    read, k = _with_text(docs, names), len(names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, k):
            bad = _judged(shared.value, batch.column(k), batch.column(k + 1))[1]
            yield pa.RecordBatch.from_arrays(batch.columns[:k], names).filter(pa.array(~bad))

    return read.mapInArrow(keep, T.StructType(read.schema.fields[:k]))
