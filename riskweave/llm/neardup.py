"""Operator 8, near duplicates by improved consistent weighted sampling.

A text is the bag of its shingles of five words, each weighing its count times
the mean inverse document frequency of its words (a shingle's own frequency
would weigh down just what large groups of near copies share, and so tear them
apart).  Consistent weighted samples of a text agree with another's at the rate
of their weighted Jaccard similarity.  Sets of samples are band keys; texts that
share a key are compared exactly.

Equal texts are one class from the start.  Within a band key every text is
compared with the key's leader only, the text that shares most keys with others:
the original of a group of edited copies, where there is one.  In keys that
still hold texts of several groups, all texts of different groups are compared:
by a join in small keys, block against block in large ones.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.graph import components
from riskweave.llm.storage import cleared, kept, materialize
from riskweave.llm.words import mixed, reduce_at, release, slices, split

WORDS = 5
THRESHOLD = 0.8
SAMPLES, ROWS, BANDS = 24, 4, 24
#: Pairs that agree in fewer samples aren't compared exactly: at the threshold that happens in under 0.04 % of pairs.
LEAST_AGREEING = 12
#: Words in at least this share of documents have their own idf, rarer ones that of this share: at most (distinct words of a mean document) / LEAST_SHARE words are broadcast.
LEAST_SHARE = 0.001
#: Texts compared with one text in one task, and their bytes.
CHUNK, CHUNK_BYTES = 64, 2 << 20
SLICE_BYTES = 1 << 18
_TABLE = 1 << 16
_RANDOM = np.random.default_rng(20_10)
# Tables of the random variates that a shingle's hash picks for each sample.
R = _RANDOM.gamma(2, 1, _TABLE).astype(np.float32)
LOG_C = np.log(_RANDOM.gamma(2, 1, _TABLE)).astype(np.float32)
BETA = _RANDOM.uniform(0, 1, _TABLE).astype(np.float32)
ODD = (_RANDOM.integers(1, 1 << 62, SAMPLES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
#: A key of at most so many texts has its texts of different groups compared, all with all.
SMALL = 24
#: Texts of a block of a larger key, and their bytes; each task has two blocks.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Rows that name the texts to compare (id, hash and place, no lists) are broadcast up to this number (about 40 MB), so that the other texts stay where they are.
MOST_NEEDS = 300_000
#: Beyond that, only texts whose hash is among those that are needed are shuffled, as long as there are no more such hashes (about 60 MB).
MOST_NAMES = 2_000_000
BAND_OF = [sorted(_RANDOM.choice(SAMPLES, ROWS, replace=False).tolist()) for _ in range(BANDS)]
_EDGE = string.punctuation + "“”‘’«»…–—¿¡"


@dataclass
class Idf:
    """Hashes of the frequent words, sorted, and the idf of each; ``rare`` is that of all others."""

    words: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.values[at], self.rare)


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.lower().strip(_EDGE) or w) for w in words), np.uint64, len(words))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a task's words with the documents that have them."""
    keys, counts = [], []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

    for batch in batches:
        release()
        for _, texts in slices(batch.column(0), SLICE_BYTES):
            words, at, bounds = split(texts)
            if not words:
                continue
            found, number = np.unique(_hashed(words), return_inverse=True)
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            once = np.unique(doc * len(found) + number[at]) % len(found)
            keys.append(found)
            counts.append(np.bincount(once, minlength=len(found)))
            if sum(map(len, keys)) > 1_000_000:
                keys, counts = ([x] for x in summed())
                if len(keys[0]) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], names=["word", "df"])
                    keys, counts = [], []
    if keys:
        k, c = summed()
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["word", "df"])


def word_idf(docs: DataFrame, *, text_col: str = "text", least_share: float = LEAST_SHARE) -> Idf:
    """Document frequencies of all words of all documents; those of the frequent words reach the driver."""
    n = docs.count()
    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count_words, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    frequent = counts.where(F.col("df") >= least_share * n).toArrow()
    words, df = frequent["word"].to_numpy().view(np.uint64), frequent["df"].to_numpy()
    order = np.argsort(words)
    return Idf(words[order], 1 + np.log(max(n, 1) / df[order]), 1 - float(np.log(least_share)))


def shingles(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, their weights, and where each text's begin.

    A text of fewer than five words is one shingle; one without words has none.
    """
    words, at, bounds = split(texts)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    own = _hashed(words)
    values, h = idf.of(own)[at], own[at]
    sizes = np.diff(bounds)
    # Places where a shingle begins: all but the last four words of a text, or its first.
    starts = np.repeat(bounds[:-1], sizes)
    length = np.repeat(np.minimum(sizes, WORDS), sizes)
    place = np.arange(len(h))
    begins = place <= np.repeat(bounds[1:], sizes) - length
    begins &= (np.repeat(sizes, sizes) >= WORDS) | (place == starts)
    place, length = place[begins], length[begins]
    key, weight = np.zeros(len(place), np.uint64), np.zeros(len(place))
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            there = k < length
            step = np.minimum(place + k, len(h) - 1)
            key = np.where(there, (key + h[step]) * np.uint64(0x9E3779B97F4A7C15), key)
            weight += np.where(there, values[step], 0.0)
    key, weight = mixed(key), weight / length
    doc = np.repeat(np.arange(len(texts)), sizes)[begins]
    order = np.lexsort((key, doc))
    key, weight, doc = key[order], weight[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at_first = np.flatnonzero(first)
    weight = np.add.reduceat(weight, at_first) if len(at_first) else weight
    return key[at_first], weight, np.concatenate([[0], np.cumsum(np.bincount(doc[at_first], minlength=len(texts)))])


def shingles_by_slices(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingles``, with the words of a slice at a time in memory."""
    parts = [shingles(some, idf) for _, some in slices(texts, SLICE_BYTES)]
    if not parts:
        return shingles(texts, idf)
    ends = np.cumsum([0, *[len(keys) for keys, _, _ in parts]])
    bounds = [bounds[1:] + first for (_, _, bounds), first in zip(parts, ends, strict=False)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], *bounds])


def samples(keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Consistent weighted samples (texts x SAMPLES), after S. Ioffe's scheme; 0 where a text has no shingle."""
    out = np.zeros((len(bounds) - 1, SAMPLES), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    log_w, starts = np.log(weights).astype(np.float32), bounds[full]
    sizes = np.diff(bounds)[full]
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            m = keys * ODD[k]
            r = R[(m >> np.uint64(48)).astype(np.int64)]
            beta = BETA[((m >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
            t = np.floor(log_w / r + beta)
            a = LOG_C[((m >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
            owner = np.searchsorted(starts, least, side="right") - 1
            one = least[np.unique(owner, return_index=True)[1]]
            out[full, k] = mixed(keys[one] + t[one].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return out


def _sign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for first, texts in slices(batch.column(2), SLICE_BYTES):
                keys, weights, bounds = shingles(texts, shared.value)
                signed = samples(keys, weights, bounds)
                lists = pa.ListArray.from_arrays(np.arange(0, signed.size + 1, SAMPLES, dtype=np.int32), pa.array(signed.ravel()))
                total = reduce_at(np.add, weights, bounds, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(total), pc.binary_length(texts).cast(pa.int64()), lists], names=["doc_id", "key", "weight", "bytes", "samples"])
        release()

    return run


def _similar(shared, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        keys, weights, bounds = shingles_by_slices(texts, shared.value)
        total = reduce_at(np.add, weights, bounds, 0.0)
        names, a = table["key"].to_pylist(), table["a"][0].as_py()
        mid = names.index(a)
        own, own_w = keys[bounds[mid] : bounds[mid + 1]], weights[bounds[mid] : bounds[mid + 1]]
        out = {}
        for i, name in enumerate(names):
            if name == a or name in out:
                continue
            k, w = keys[bounds[i] : bounds[i + 1]], weights[bounds[i] : bounds[i + 1]]
            at = np.minimum(np.searchsorted(own, k), len(own) - 1)
            common = np.where(own[at] == k, np.minimum(own_w[at], w), 0.0).sum()
            out[name] = common / max(total[mid] + total[i] - common, 1e-12)
        out = {k: v for k, v in out.items() if v >= threshold - 1e-9}
        return pa.table({"a": pa.array([a] * len(out), pa.binary()), "b": pa.array(list(out), pa.binary()), "similarity": pa.array(list(out.values()), pa.float64())})

    return run


def _candidates(threshold: float, least: int):
    """Of two blocks of a key, the texts that may be similar to others: their numbers in the task and those of the others.

    A pair is named in the first key that it shares only.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one, other = table["i"][0].as_py(), table["j"][0].as_py()
        which, block, weight = table["which"][0].as_py(), table["block"].to_numpy(), table["weight"].to_numpy()
        label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        signed = table["samples"].combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
        right = np.flatnonzero(block == other)
        partners: dict[int, np.ndarray] = {}
        for p in np.flatnonzero(block == one):
            q = right[right > p] if one == other else right
            q = q[(label[q] != label[p]) & (np.minimum(weight[q], weight[p]) >= (threshold - 1e-9) * np.maximum(weight[q], weight[p]))]
            same = signed[q] == signed[p]
            enough = same.sum(axis=1) >= least
            q, same = q[enough], same[enough]
            shared = same[:, np.array(BAND_OF)].all(axis=2)
            q = q[shared.any(axis=1) & (shared.argmax(axis=1) == which)]
            if len(q):
                partners[int(p)] = q
        rows = np.unique(np.concatenate([[*partners], *partners.values()])).astype(np.int32) if partners else np.zeros(0, np.int32)
        lists = [partners.get(int(r), np.zeros(0)).astype(np.int32) for r in rows]
        return table.select(["band", "i", "j", "key"]).take(pa.array(rows)).append_column("at", pa.array(rows)).append_column("partners", pa.array(lists, pa.list_(pa.int32())))

    return run


def _joined(shared, threshold: float):
    """Links that join the similar ones of a task's pairs; a pair that others have joined needs none."""

    def run(table: pa.Table, lists: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        at = table["at"].to_numpy()
        table = table.take(pa.array(np.unique(at, return_index=True)[1]))  # rows may repeat id and text
        at, names = table["at"].to_numpy(), table["key"].to_pylist()
        keys, weights, bounds = shingles_by_slices(table["text"].combine_chunks(), shared.value)
        total = reduce_at(np.add, weights, bounds, 0.0)
        found, ids = np.unique(keys, return_inverse=True)
        own, group = np.zeros(len(found)), np.arange(len(names))
        out = []
        for own_at, partners in zip(lists["at"].to_pylist(), lists["partners"], strict=True):
            p = int(np.searchsorted(at, own_at))
            q = np.searchsorted(at, partners.values.to_numpy().astype(at.dtype))
            q = q[group[q] != group[p]]
            if not len(q):
                continue
            own[ids[bounds[p] : bounds[p + 1]]] = weights[bounds[p] : bounds[p + 1]]
            common = np.array([np.minimum(own[ids[bounds[x] : bounds[x + 1]]], weights[bounds[x] : bounds[x + 1]]).sum() for x in q])
            own[ids[bounds[p] : bounds[p + 1]]] = 0
            similarity = common / np.maximum(total[p] + total[q] - common, 1e-12)
            for x, y in zip(q.tolist(), similarity.tolist(), strict=True):
                if y >= threshold - 1e-9 and group[x] != group[p]:
                    group[group == group[x]] = group[p]
                    out.append((names[p], names[x], y))
        a, b, similarity = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(similarity, pa.float64())})

    return run


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _alike(threshold: float, least: int) -> Column:
    """On columns weight, samples, weight_b, samples_b: may be similar enough, by size and samples."""
    return (F.least("weight", "weight_b") >= (threshold - 1e-9) * F.greatest("weight", "weight_b")) & (_agreeing(F.col("samples"), F.col("samples_b")) >= least)


def _keyed(texts: DataFrame, bands: list[list[int]]) -> DataFrame:
    """band (and which of ``bands`` it is), key, n and leader a for every key that more than one text has."""
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), *[F.get("samples", k) for k in own]) for i, own in enumerate(bands)])).alias("which", "band")
    keyed = texts.select("key", band)
    counts = materialize(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialize(keyed.join(counts, "band"))
    rank = materialize(shared.groupBy("key").agg(F.sum(F.log(F.col("n").cast("double"))).alias("rank")))
    ranked = materialize(shared.join(rank, "key"))
    leaders = materialize(ranked.groupBy("band").agg(F.max(F.struct("rank", "key")).alias("a")).select("band", "a.key").withColumnRenamed("key", "a"))
    return materialize(ranked.drop("rank").join(leaders, "band"))


def _crossing(labelled: DataFrame) -> DataFrame:
    """Pairs of texts of small keys that carry different labels."""
    own = labelled.where(F.col("n") <= SMALL).select("band", "key", "label")
    other = own.select("band", F.col("key").alias("b"), F.col("label").alias("b_label"))
    return own.withColumnRenamed("key", "a").join(other, "band").where((F.col("a") < F.col("b")) & (F.col("label") != F.col("b_label"))).select("a", "b").distinct()


def near_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key), key naming the whole text; links (a, b, similarity) between keys that connect similar texts; the label of each linked key's group."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    idf = docs.sparkSession.sparkContext.broadcast(word_idf(rows))  # frequent words only
    signed = materialize(rows.mapInArrow(_sign(idf), "doc_id long, key binary, weight double, bytes long, samples array<long>"))
    texts = materialize(signed.where("weight > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("bytes").alias("bytes"), F.first("samples").alias("samples")))
    left = texts.select(F.col("key").alias("a"), "weight", "samples")
    right = texts.select(F.col("key").alias("b"), "bytes", F.col("weight").alias("weight_b"), F.col("samples").alias("samples_b"))

    def with_text(needs: DataFrame) -> DataFrame:
        """``needs`` (slim rows) with the text of each key."""
        needs = materialize(needs.join(texts.select("key", F.coalesce("doc_id", F.lit(-1)).alias("_id")), "key"))
        own = rows.withColumn("_id", F.coalesce("doc_id", F.lit(-1)))
        small = needs.limit(MOST_NEEDS + 1).count() <= MOST_NEEDS
        if not small:
            names = materialize(needs.select(F.xxhash64("key", "_id").alias("_name")).distinct())
            if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES:
                own = own.withColumn("_name", F.xxhash64("key", "_id")).join(F.broadcast(names), "_name", "left_semi").drop("_name")
        return own.join(F.broadcast(needs) if small else needs, ["key", "_id"]).select(*[c for c in needs.columns if c != "_id"], "text")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar: a's text meets those of b in chunks."""
        pairs = materialize(materialize(pairs).join(right, "b").join(left, "a").where(_alike(threshold, LEAST_AGREEING)).select("a", "b", "bytes"))
        chunks = materialize(pairs.groupBy("a").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("bytes") / CHUNK_BYTES)).alias("chunks")))
        pairs = materialize(pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest("chunks", F.lit(1))).alias("chunk")))
        needs = pairs.select(F.col("b").alias("key"), "a", "chunk").unionByName(pairs.select(F.col("a").alias("key"), "a", "chunk").distinct())
        return materialize(with_text(needs).groupBy("a", "chunk").applyInArrow(_similar(idf, threshold), "a binary, b binary, similarity double"))

    def rest(large: DataFrame) -> DataFrame:
        """Links among texts of large keys that carry different labels: all pairs, block against block."""
        sized = large.join(texts.select("key", "weight", "bytes", "samples"), "key")
        blocks = sized.groupBy("band").agg(F.greatest(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)), F.lit(1)).cast("int").alias("blocks"))
        own = sized.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        met = own.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "_to")).withColumn("j", F.greatest("block", "_to"))
        met = met.select("band", "i", "j", "which", "block", "key", "label", "weight", "samples")
        found = materialize(met.groupBy("band", "i", "j").applyInArrow(_candidates(threshold, LEAST_AGREEING), "band long, i int, j int, key binary, at int, partners array<int>"))
        # Lists of partners go to their task by themselves, texts by the slim rows that name them.
        meant = with_text(found.select("band", "i", "j", "key", "at"))
        lists = found.where(F.size("partners") > 0).select("band", "i", "j", "at", "partners")
        return materialize(meant.groupBy("band", "i", "j").cogroup(lists.groupBy("band", "i", "j")).applyInArrow(_joined(idf, threshold), "a binary, b binary, similarity double"))

    keyed = _keyed(texts, BAND_OF)
    star = lambda k: k.where(F.col("a") != F.col("key")).select("a", F.col("key").alias("b")).distinct()
    links = verified(star(keyed))

    labels = components(links)
    label = lambda k: materialize(k.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    mixed = lambda k: k.join(materialize(k.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("band")), "band")
    apart = materialize(mixed(label(keyed)))
    more = verified(_crossing(apart))
    large = apart.where(F.col("n") > SMALL)
    if large.limit(1).count():
        more = more.unionByName(rest(large))
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = components(links)
    return signed.select("doc_id", "key"), links, labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The group of every document.

    Returns one row for each row of ``docs``: doc_id, key (of the whole text),
    class_id (smallest doc_id of its group), class_rows (rows of the group) and
    kept (true for one doc_id of each group).

    A group is all texts that are joined by links of at least ``threshold``; a
    text without any is a group of its own with its equal copies.  Null, empty
    and white-space texts have no shingles and are grouped with equal ones only,
    null as empty.  A text of fewer than five words is one shingle.  A group
    without any id has a null class_id and keeps all its rows.  Rows that repeat
    id and text are kept or not together.  An empty table gives an empty result.
    Other columns are ignored.
    """
    with cleared():
        rows, _, labels = near_links(docs, id_col=id_col, text_col=text_col, threshold=threshold)
        labelled = kept(rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
        groups = kept(labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows")))
    return labelled.join(groups, "label").select("doc_id", "key", "class_id", "class_rows", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with its smallest id.

    Of rows that repeat id and text one stays; of a group without any id one row
    for each different text.  All columns stay.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    keepers = materialize(groups.where("kept").groupBy("key", F.coalesce("doc_id", F.lit(-1)).alias("_id")).agg(F.count(F.lit(1)).alias("_rows")))
    own = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_id")).join(keepers, ["key", "_id"])
    if keepers.where("_rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["key", "_id"])
    return rows.select("row.*")
