"""Operator 9, quality classifier: an interpolated modified Kneser-Ney model of characters.

Five-grams of all trusted text are counted in shards.  Lower orders, contexts and
probabilities are joins and sums of that one count table: a gram is five symbols
of 12 bits in one number, so its context and its suffix are shifts and masks.
The whole table of probabilities and back-off weights stays in shards.  Texts are
scored in chunks: a chunk's distinct grams are joined with the table, those that
it doesn't have with that of the next lower order, and come back to the chunk with
their log-probabilities.  A document passes if its perplexity lies within two
quantiles of its language's trusted, held-out documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.storage import cleared, kept, materialize
from riskweave.llm.words import reduce_at, release, slices

ORDER, BITS = 5, 12
BEGIN, END = 1, 2
#: Trusted ids are broadcast up to this number, joined by a shuffle beyond it.
MOST_IDS = 2_000_000
#: Scores are broadcast up to this number, joined by a shuffle beyond it.
MOST_SCORES = 500_000
#: Bytes of text that share their grams' log-probabilities: one task's work.
CHUNK_BYTES = 24 << 20
#: One trusted document in so many sets the quantiles and doesn't teach.
HELD_OUT = 4
#: A language with fewer held-out documents takes the quantiles of all.
LEAST_DOCUMENTS = 30
#: Symbols that a document is given at its language's median, so that short ones aren't judged by chance.
SHRINK = 60
#: Documents below or above these quantiles of their language's trusted documents are rejected.
LOW, HIGH = 0.002, 0.998
#: Of quantiles: ranks are right to one in so many documents.
ACCURACY = 10_000
#: Bytes of text and symbols worked on at a time; a longer text is cut.
SLICE_BYTES, SLICE_SYMBOLS = 1 << 20, 1 << 20
#: Bytes of text that a task packs before it hands its batches on.
PACK_BYTES = 16 << 20


def _points(text: str) -> np.ndarray:
    """A text's symbols: white space of any length is one space, digits are one symbol, characters beyond 12 bits share the upper half."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where((points >= 48) & (points <= 57), 48, points)
    return np.where(points >= 4096, 2048 + points % 2048, np.maximum(points, END + 1))


def symbols(texts: pa.Array, pad: int = ORDER - 1) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ``pad`` begins before it and an end after it, and where each begins."""
    raw = [" ".join(x.split()) for x in texts.to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    points = _points("".join(raw))
    bounds = np.concatenate([[0], np.cumsum(sizes + pad + 1)])
    out = np.full(bounds[-1], BEGIN, np.int64)
    out[np.arange(len(points)) + np.repeat(np.arange(len(raw)) * (pad + 1) + pad, sizes)] = points
    out[bounds[1:] - 1] = END
    return out, bounds


def _wide(codes: np.ndarray) -> np.ndarray:
    """The five-gram that ends at each symbol but the first four."""
    pad = ORDER - 1
    wide = codes[pad:].copy() if len(codes) else codes
    for k in range(1, ORDER):
        wide += codes[pad - k : len(codes) - k] << (BITS * k)
    return wide


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The five-gram that ends at each symbol of each text, and where each text's begin."""
    codes, bounds = symbols(texts)
    pad = ORDER - 1
    wide = _wide(codes)
    keep = np.ones(len(wide), bool)
    for k in range(pad):  # what begins in one text and ends among the begins of the next
        keep[bounds[1:-1] + k - pad] = False
    return wide[keep], np.concatenate([[0], np.cumsum(np.diff(bounds) - pad)])


def parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, grams, bounds) of about a megabyte of text each; a longer text comes in several parts, none of its grams lost or twice."""
    for first, some in slices(texts, SLICE_BYTES):
        if len(some) > 1 or len(some[0].as_buffer() or b"") <= SLICE_BYTES:
            yield first, *grams(some)
            continue
        text = " ".join(some[0].as_py().split())
        begin, end = np.full(ORDER - 1, BEGIN, np.int64), np.full(1, END, np.int64)
        for at in range(0, len(text), SLICE_SYMBOLS):
            points = _points(text[at : at + SLICE_SYMBOLS])
            wide = _wide(np.concatenate([begin, points, end] if at + SLICE_SYMBOLS >= len(text) else [begin, points]))
            begin = np.concatenate([begin, points])[1 - ORDER :]
            yield first, wide, np.array([0, len(wide)])


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Five-grams of a task's texts with their counts; sums meet again whenever a million have come together."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, wide, _ in parts(batch.column(0)):
            found.append(np.unique(wide, return_counts=True))
            if sum(len(p[0]) for p in found) > 2_000_000:
                found = [_distinct(found)]
                if len(found[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["gram", "n"])
                    found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _distinct(found)], names=["gram", "n"])
    release()


@dataclass
class Model:
    """For each order, grams with their log2 probabilities (gram, log), and contexts with the log2 weights of what they leave to lower orders (context, rest); whole tables in shards."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    unknown: float

    def looked_up(self, wanted: DataFrame) -> DataFrame:
        """(gram, log) for each distinct five-gram of ``wanted`` (gram): log2 probability of its last symbol after the others.

        From the highest order down, only suffixes of grams that an order doesn't
        have go on to the next; then their logs come back up.
        """
        known, unknown = {}, {}
        rows = wanted.select("gram")
        for k in range(ORDER, 0, -1):
            # The distinct grams are already dealt as the join wants them.
            met = materialize(rows.distinct().join(self.grams[k - 1], "gram", "left"))
            known[k] = met.where("log IS NOT NULL")
            missing = met.where("log IS NULL").select("gram", F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1).alias("suffix"))
            rests = F.broadcast(self.contexts[k - 1]) if k <= 2 else self.contexts[k - 1]  # none or one symbol: at most 4,096 rows
            unknown[k] = materialize(missing.join(rests, "context", "left").select("gram", "suffix", F.coalesce("rest", F.lit(0.0)).cast("float").alias("rest")))
            rows = unknown[k].select(F.col("suffix").alias("gram"))
        # Order 1 always stands on the uniform distribution.
        lower = known[1].unionByName(unknown[1].select("gram", (F.col("rest") + self.unknown).cast("float").alias("log")))
        for k in range(2, ORDER + 1):
            lower = materialize(lower)
            below = unknown[k].join(lower.select(F.col("gram").alias("suffix"), F.col("log").alias("below")), "suffix")
            lower = known[k].unionByName(below.select("gram", (F.col("rest") + F.col("below")).alias("log")))
        return materialize(lower)

    def log2(self, wide: np.ndarray) -> np.ndarray:
        """As ``looked_up``, for a few grams in the driver."""
        keys, inverse = np.unique(wide, return_inverse=True)
        if not len(keys):
            return np.zeros(0)
        found = self.looked_up(self.grams[0].sparkSession.createDataFrame([(int(x),) for x in keys], "gram long")).toArrow().sort_by("gram")
        return found["log"].to_numpy()[inverse]

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each of a few texts in the driver, and its symbols, the end counted."""
        wide, bounds = grams(texts)
        return reduce_at(np.add, -self.log2(wide), bounds, 0.0), np.diff(bounds)


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many grams have each of 1 to 4."""
    if not n.get(1) or not n.get(2):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) else k - 0.5 for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def train(texts: DataFrame, *, text_col: str = "text") -> Model | None:
    """The model of all ``texts``; None where there is no text."""
    one = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text != ''")
    full = materialize(one.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    # Order k: c is what Kneser-Ney counts (occurrences in the highest order, distinct symbols before the gram in the others), n the occurrences.
    tables = {ORDER: full.select("gram", F.col("n").alias("c"), "n")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy(F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")))
    of_all = reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("k"), F.least("c", F.lit(5)).alias("c"), "n") for k, t in tables.items()])
    seen = {(r["k"], r["c"]): r for r in of_all.groupBy("k", "c").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("n")).collect()}  # at most 25 rows
    total = sum(r["n"] for (k, _), r in seen.items() if k == ORDER)
    if not total:
        return None
    distinct = sum(r["grams"] for (k, _), r in seen.items() if k == 1) + 1
    lower, logs, rests = None, [], []
    for k in range(1, ORDER + 1):
        counts = tables[k]
        d = _discounts({c: r["grams"] for (own, c), r in seen.items() if own == k and c <= 4})
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = materialize(counts.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("c").alias("all"), (F.sum(discount) / F.sum("c")).alias("rest")))
        known = counts.withColumn("context", F.shiftright("gram", BITS)).join(contexts, "context")
        below = F.lit(1.0 / distinct)
        if lower is not None:
            known = known.withColumn("suffix", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        lower = materialize(known.select("gram", ((F.col("c") - discount) / F.col("all") + F.col("rest") * below).alias("p")))
        logs.append(lower.select("gram", F.log2("p").cast("float").alias("log")))
        rests.append(contexts.select("context", F.log2("rest").cast("float").alias("rest")))
    return Model(logs, rests, -float(np.log2(distinct)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (chunk, key, id, text) as compressed batches, for each chunk; of rows with one key and id one."""
    schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("text", pa.string())])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    waiting: dict[int, list[pa.RecordBatch]] = {}
    seen: set[tuple[bytes, int | None]] = set()
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        blobs = []
        for own in waiting.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=options) as writer:
                writer.write_table(pa.Table.from_batches(own, schema).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(waiting), pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

    for batch in batches:
        chunk = batch.column(0).to_numpy(zero_copy_only=False)
        names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        new = np.array([i for i, x in enumerate(names) if not (x in seen or seen.add(x))], np.int64)
        rows = pa.RecordBatch.from_arrays([batch.column(k + 1).cast(kind) for k, kind in enumerate(schema.types)], schema=schema)
        order = new[np.argsort(chunk[new], kind="stable")]
        ends = np.flatnonzero(np.append(np.diff(chunk[order]) != 0, True)) + 1 if len(order) else []
        first = 0
        for end in ends:
            waiting.setdefault(int(chunk[order[first]]), []).append(rows.take(pa.array(order[first:end])))
            first = end
        size += batch.nbytes
        if size > PACK_BYTES and waiting:
            yield from flushed()
            waiting, seen, size = {}, set(), 0
    if waiting:
        yield from flushed()
    release()


def _unpacked(blobs: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk, a blob at a time; of rows with one key and id one."""
    seen: set[tuple[bytes, int | None]] = set()
    for blob in blobs:
        with pa.ipc.open_stream(blob.as_buffer()) as reader:
            for batch in reader:
                names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                yield batch.filter(pa.array([not (x in seen or seen.add(x)) for x in names], pa.bool_()))


def _wanted(table: pa.Table) -> pa.Table:
    """The distinct grams of a chunk."""
    release()
    keys, fresh, waiting = np.zeros(0, np.int64), [], 0
    for batch in _unpacked(table["blob"]):
        for _, wide, _ in parts(batch.column(2)):
            fresh.append(np.unique(wide))
            waiting += len(fresh[-1])
            if waiting > 2_000_000:
                keys, fresh, waiting = np.unique(np.concatenate([keys, *fresh])), [], 0
    keys = np.unique(np.concatenate([keys, *fresh]))
    return pa.table({"chunk": pa.array(np.full(len(keys), table["chunk"][0].as_py(), np.int64)), "gram": pa.array(keys)})


def _summed(table: pa.Table, known: pa.Table) -> pa.Table:
    """Bits and symbols of a chunk's texts, from the logs of its grams."""
    keys, logs = known["gram"].to_numpy(), known["log"].to_numpy()
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order].astype(np.float64)
    out = []
    for batch in _unpacked(table["blob"]):
        bits, sizes = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
        for first, wide, bounds in parts(batch.column(2)):
            here = slice(first, first + len(bounds) - 1)
            bits[here] += reduce_at(np.add, -logs[np.searchsorted(keys, wide)], bounds, 0.0)
            sizes[here] += np.diff(bounds)
        out.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits), pa.array(sizes)], names=["key", "id", "bits", "symbols"]))
    release()
    return pa.Table.from_batches(out)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (``text_key``), id, bits (of the whole text) and symbols of each distinct (text, id).

    Texts travel to their chunk compressed, once to tell their grams and once to
    meet the logs; no copy of them is written.  Copies of a text are spread over
    chunks by their ids; rows that repeat both are one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(text_key(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("key", "id"), F.lit(size // CHUNK_BYTES + 1)).alias("chunk"), "key", "id", "text")
    packed = rows.mapInArrow(_packed, "chunk long, blob binary").groupBy("chunk")
    with cleared():
        wanted = materialize(packed.applyInArrow(_wanted, "chunk long, gram long"))
        known = kept(wanted.join(model.looked_up(wanted), "gram").select("chunk", "gram", "log"))
    return kept(packed.cogroup(known.groupBy("chunk")).applyInArrow(_summed, "key binary, id long, bits double, symbols long"))


def quantile(column: str, q: float) -> Column:
    """The quantile of a group; of one too small to have any value beyond it, that of the normal distribution with the group's mean and deviation."""
    sampled = F.count(column) * min(q, 1 - q) >= 1
    return F.when(sampled, F.percentile_approx(column, q, ACCURACY)).otherwise(F.avg(column) + NormalDist().inv_cdf(q) * F.stddev_pop(column))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", low: float = LOW, high: float = HIGH, keep_rows: bool = False) -> DataFrame:
    """Which documents are of good quality.

    Returns one row for each row of ``docs``: doc_id, lang, symbols, perplexity
    (of a symbol), judged (the perplexity that is judged: with SHRINK symbols at the language's median), low, high (the
    ``low`` and ``high`` quantiles of judged among the language's held-out trusted documents) and kept; with ``keep_rows`` also row, the input row as a struct.

    Documents with label 1 and not also label 0 are trusted; most teach the
    model, the rest set the quantiles.  Texts that are null, empty or white space
    have no perplexity and aren't kept.  The null language and languages with few
    held-out documents take the quantiles of all.  Without trusted text every
    document with text is kept.  A null id is never trusted.  Repeated rows are
    judged each for itself.  An empty table gives an empty result.  Other columns
    are ignored, or stay in row, whatever their names.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    base = docs.select(*whole, F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("g")).where("g = 1").select("doc_id")
    small = good.limit(MOST_IDS + 1).count() <= MOST_IDS
    marked = F.broadcast(good) if small else good
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    rows = base.select(*(["row"] if keep_rows else []), "doc_id", "lang", text_key(F.col("text")).alias("key"), blank.alias("blank"))
    with cleared():
        model = train(base.where(~held).join(marked, "doc_id", "left_semi"))
        scores = None if model is None else score(base, model)
    if scores is None:
        none = F.lit(None).cast("double")
        return rows.select(*(["row"] if keep_rows else []), "doc_id", "lang", F.lit(0).cast("long").alias("symbols"), none.alias("perplexity"), none.alias("judged"), none.alias("low"), none.alias("high"), (~F.col("blank")).alias("kept"))

    found = scores.withColumnRenamed("id", "_id").withColumnRenamed("key", "_key")
    found = F.broadcast(found) if scores.limit(MOST_SCORES + 1).count() <= MOST_SCORES else found

    def measured(some: DataFrame) -> DataFrame:
        met = some.join(found, (some["key"] == F.col("_key")) & some["doc_id"].eqNullSafe(F.col("_id")))
        return met.drop("_key", "_id", "key").withColumn("rate", F.when(~F.col("blank"), F.col("bits") / F.col("symbols")))

    enough = lambda rows, *found: rows.groupBy("lang").agg(*found, F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_DOCUMENTS) & F.col("lang").isNotNull()).drop("n")
    with cleared():
        calibration = materialize(measured(rows.select("doc_id", "lang", "key", "blank").where(held).join(marked, "doc_id", "left_semi")).where("rate IS NOT NULL").select("lang", "rate", "symbols"))
        middle = F.percentile_approx("rate", 0.5, ACCURACY).alias("centre")
        all_centre = calibration.agg(middle).first()["centre"] or 0.0
        centres = materialize(enough(calibration, middle))
        centre = F.coalesce(F.col("centre"), F.lit(all_centre))
        # Both sides of the comparison are shrunk.
        shrunk = (F.col("rate") * F.col("symbols") + SHRINK * centre) / (F.col("symbols") + SHRINK)
        again = calibration.join(centres, "lang", "left").withColumn("rate", shrunk)
        both = [quantile("rate", q).alias(name) for q, name in ((low, "q_low"), (high, "q_high"))]
        all_q = again.agg(*both).first()
        all_q = [0.0, 1e3] if all_q["q_low"] is None else list(all_q)
        limits = kept(centres.join(enough(again, *both), "lang"))
    few = limits.limit(10_001).count() <= 10_000
    judged = measured(rows).join(F.broadcast(limits) if few else limits, "lang", "left").withColumn("rate_judged", shrunk)
    lowest, highest = F.coalesce("q_low", F.lit(all_q[0])), F.coalesce("q_high", F.lit(all_q[1]))
    bits = lambda x: F.pow(F.lit(2.0), x)
    passes = F.coalesce(F.col("rate_judged").between(lowest, highest), F.lit(False))
    return judged.select(*(["row"] if keep_rows else []), "doc_id", "lang", F.when(~F.col("blank"), F.col("symbols")).otherwise(0).alias("symbols"), bits(F.col("rate")).alias("perplexity"), bits(F.col("rate_judged")).alias("judged"), bits(lowest).alias("low"), bits(highest).alias("high"), passes.alias("kept"))
