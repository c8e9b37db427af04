"""Operator 4, toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams; every n-gram has a vector, a text is
the mean of its words' vectors, and a linear softmax reads that mean.  Vectors
and softmax are trained jointly in numpy on the driver, on a bounded sample of
labelled rows.  A misspelt toxic word shares most n-grams with its model, so it
gets nearly its vector.  As the softmax is linear, a trained model is one number
for each n-gram bucket, and tasks score whole texts with that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.words import mixed, reduce_at, release, slices, split

BUCKETS = 1 << 17
DIMENSIONS = 10
#: Lengths of character n-grams; words count with ``<`` before and ``>`` after them.
GRAMS = (3, 4, 5, 6)
#: Labelled rows of each class that training takes at most, and their characters altogether: what bounds the driver's memory.  Rows are drawn by a hash of their ids, whatever their length.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 8_000_000
EPOCHS, BATCH, RATE = 8, 32, 0.2
#: Buckets of fewer texts of the sample have no vector: they would only be learnt by heart.
LEAST_TEXTS = 3
#: Bytes of text scored at a time.
SLICE_BYTES = 1 << 20
CUTOFF = 0.3


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def word_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the lower-cased words, and where each word's begin."""
    marked = [f"<{w.lower()}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place, word = np.arange(len(points)), np.repeat(np.arange(len(marked)), sizes)
    found, owner = [], []
    with np.errstate(over="ignore"):
        rolling = points.copy()
        for n in range(2, max(GRAMS) + 1):
            rolling[: len(points) - n + 1] = rolling[: len(points) - n + 1] * np.uint64(1000003) + points[n - 1 :]
            if n in GRAMS:
                whole = place + n <= ends
                found.append(mixed(rolling[whole] + np.uint64(n)) % np.uint64(buckets))
                owner.append(word[whole])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(marked))
    return np.concatenate(found)[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text as distinct buckets and their shares of the mean over its words."""
    words, at, bounds = split(texts)
    if not words:
        return [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * len(texts)
    found, starts = word_buckets(words)
    weight = 1.0 / np.maximum(np.diff(starts), 1)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, times = np.unique(at[a:b], return_counts=True)
        parts = [found[starts[w] : starts[w + 1]] for w in own]
        each = np.repeat(times * weight[own] / max(b - a, 1), [len(p) for p in parts]) if parts else np.zeros(0)
        ids, inverse = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_inverse=True)
        out.append((ids.astype(np.int32), np.bincount(inverse, weights=each, minlength=len(ids)).astype(np.float32)))
    return out


@dataclass
class Model:
    """``table``: for each bucket, its vector times the difference of the softmax's two rows."""

    table: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, at, bounds = split(texts)
        if words:
            found, starts = word_buckets(words)
            per_word = reduce_at(np.add, self.table[found], starts, 0.0) / np.maximum(np.diff(starts), 1)
            total = reduce_at(np.add, per_word[at], bounds, 0.0)
        else:
            total = np.zeros(len(bounds) - 1)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(np.diff(bounds), 1))))


def train(texts: list[str], toxic: list[int], prior: float, *, seed: int = 7) -> Model:
    """Vectors and softmax by Adagrad on mini-batches.

    ``prior`` is the share of toxic rows among all labelled ones; the sample may
    be richer in them, and the bias is moved back accordingly.
    """
    y = np.asarray(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    # Bags are made twice, so that only what trains is ever held, in two arrays of known size.
    parts = [part for _, part in slices(pa.array(texts, pa.string()), 1 << 18)]
    texts_of = np.zeros(BUCKETS, np.int64)
    for part in parts:
        for own_ids, _ in bags(part):
            texts_of[own_ids] += 1
    used = np.flatnonzero(texts_of >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    size = int(texts_of[used].sum())
    bag_ids, bag_weights, bounds = np.empty(size, np.int32), np.empty(size, np.float32), [0]
    for part in parts:
        for own_ids, own_weights in bags(part):
            there = place[own_ids] >= 0
            bounds.append(bounds[-1] + int(there.sum()))
            bag_ids[bounds[-2] : bounds[-1]], bag_weights[bounds[-2] : bounds[-1]] = place[own_ids][there], own_weights[there]
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (len(used), DIMENSIONS))
    softmax, bias = random.normal(0, 1, (DIMENSIONS, 2)), np.zeros(2)
    seen_v, seen_s, seen_b = np.full(len(used), 1e-10), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        rate, order = RATE * (1 - epoch / EPOCHS), random.permutation(len(y))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            ids, weights = (np.concatenate([x[bounds[k] : bounds[k + 1]] for k in own]) for x in (bag_ids, bag_weights))
            doc = np.repeat(np.arange(len(own)), [bounds[k + 1] - bounds[k] for k in own])
            mean = np.zeros((len(own), DIMENSIONS))
            spread = vectors[ids] * weights[:, None]
            for d in range(DIMENSIONS):
                mean[:, d] = np.bincount(doc, weights=spread[:, d], minlength=len(own))
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            back = p @ softmax.T
            touched, inverse = np.unique(ids, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, weights=back[doc, d] * weights, minlength=len(touched)) for d in range(DIMENSIONS)], axis=1)
            seen_v[touched] += (gradient**2).mean(axis=1)
            vectors[touched] -= rate * gradient / np.sqrt(seen_v[touched])[:, None]
            step = mean.T @ p
            seen_s += step**2
            softmax -= rate * step / np.sqrt(seen_s)
            down = p.sum(axis=0)
            seen_b += down**2
            bias -= rate * down / np.sqrt(seen_b)
    table = np.zeros(BUCKETS)
    table[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    share, prior = y.mean(), min(max(prior, 1e-4), 1 - 1e-4)
    return Model(table, float(bias[1] - bias[0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample_rows`` labelled rows of each class, those with the smallest hashes, as far as they have ``sample_chars`` characters together (one row at least).

    Only rows whose crc32 of the id is not 2 by 4 teach.  Labels other than 0 and
    1 are ignored; an id with several labels has the larger, one with several
    texts the last of them in order.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_toxic"))
    known = known.where(F.col("_id").isNotNull() & ~is_held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    there = docs.select(F.col(id_col).cast("long").alias("_id"), F.length(text_col).alias("_n")).where("_n > 0").groupBy("_id").agg(F.max("_n").alias("_n"))
    known = known.join(there, "_id")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("_toxic")).first()
    chosen = [known.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).collect() for k in (0, 1)]  # at most sample_rows ids
    ids = []
    for rows in chosen:
        before = np.cumsum([0, *[r["_n"] for r in rows]])
        ids += [(r["_id"], r["_toxic"]) for r, size in zip(rows, before, strict=False) if size + r["_n"] <= sample_chars or r is rows[0]]
    own = docs.sparkSession.createDataFrame(ids, "_id long, _toxic int")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0).join(F.broadcast(own), "_id")
    one = texts.groupBy("_id", "_toxic").agg(F.max("_text").alias("_text")).toArrow().sort_by("_id")
    sample, marks = one["_text"].to_pylist(), one["_toxic"].to_pylist()
    del one
    pa.default_memory_pool().release_unused()
    return train(sample, marks, (toxic or 0) / n if n else 0.1)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``; all columns stay, one of the same name is replaced."""
    keep = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            parts = [own.scores(texts) for _, texts in slices(batch.column(at).cast(pa.string()), SLICE_BYTES)]
            result = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, name])
            release()

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts get the score of a text without words.  A null id is
    kept and not held out.  Repeated rows are scored each for itself.  Without
    labels of both classes every text gets the share of toxic labels.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(rows, labels.withColumnRenamed(id_col, "doc_id"))
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return score(rows, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"))
