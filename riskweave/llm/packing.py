"""Operator 10, best-fit packing by hierarchical residuals.

Every partition turns its texts into token pieces and packs them best-fit,
largest first.  Nearly full bins leave at once; bins with room left become the
items of the next round, in which fewer partitions hold the leftovers of many.
Only leftovers move, so the shuffles are a small part of the pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.storage import materialize
from riskweave.llm.words import release, slices, split_arrow

CAPACITY = 2048
#: A bin of at least this share of the capacity is not packed further.
NEARLY_FULL = 0.998
#: Bins that one task of a later round packs.
BINS_PER_TASK = 50_000
#: Partitions whose leftovers meet in the next round.
FAN_IN = 8
#: Pieces that a task of the first round holds before it packs them.
PIECES_AT_ONCE = 100_000
#: Distinct words whose ids a worker keeps.
WORDS_KEPT = 600_000
#: Bytes of text whose words are looked up together; a task holds about 25 times as much for it.
SLICE_BYTES = 1 << 20

MEMBER = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)
BIN = T.StructType(
    [
        T.StructField("bin_id", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("members", T.ArrayType(MEMBER)),
    ]
)
ARROW_BIN = pa.schema(
    [
        ("bin_id", pa.int64()),
        ("length", pa.int64()),
        ("closed", pa.bool_()),
        ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))),
    ]
)


#: A word of Latin letters and the marks after it; the tokenizer lower-cases the letters and takes the marks as a word of their own.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?*%&$#|]*$"
LETTERS, MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?*%&$#|]+$"


class WordEncoder:
    """Token ids of whole texts; each distinct word is given to the tokenizer once.

    The tokenizer drops white space before it merges, so the ids of a text are
    those of its words in order.  Plain words are known by their lower-cased
    letters and their marks, all others as they stand.
    """

    def __init__(self, path: str):
        # Spark's tasks are the threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct units, and the two of each word; the empty one stands where a word has no second."""
        plain = pc.match_substring_regex(words, PLAIN)
        letters = pc.if_else(plain, pc.utf8_lower(pc.replace_substring_regex(words, MARKS, "")), words)
        marks = pc.if_else(plain, pc.replace_substring_regex(words, LETTERS, ""), "")
        coded = pa.concat_arrays([letters, marks]).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, np.stack([at[: len(words)], at[len(words) :]], axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text begins."""
        words, at, bounds = split_arrow(texts)
        units, pairs = self.units(words)
        units = units.to_pylist()
        missing = [u for u in units if u not in self.known]
        if len(self.known) + len(missing) > WORDS_KEPT:
            self.known, missing = {}, units
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            self.known.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        ids = [self.known[u] for u in units]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        places = pairs[at].ravel()
        each = sizes[places]
        ends = np.concatenate([[0], np.cumsum(each)])
        chosen = np.arange(ends[-1]) + np.repeat(starts[places] - ends[:-1], each)
        return flat[chosen], ends[2 * bounds]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest items first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has room r
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _merged(items: list[tuple[int, list[dict]]], capacity: int) -> list[tuple[int, list[dict]]]:
    out = []
    for own in best_fit([n for n, _ in items], capacity):
        base, members = 0, []
        for i in own:
            n, inside = items[i]
            members += [m | {"offset": m["offset"] + base} for m in inside] if base else inside
            base += n
        out.append((base, members))
    return out


class _Writer:
    """Numbers the bins of one task and writes them in batches."""

    def __init__(self, level: int, full: int):
        self.next, self.full = (level << 58) | (TaskContext.get().partitionId() << 32), full

    def batches(self, bins: list[tuple[int, list[dict]]]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(bins), 5000):
            part = bins[i : i + 5000]
            rows = [{"bin_id": self.next + k, "length": n, "closed": n >= self.full, "members": m} for k, (n, m) in enumerate(part)]
            self.next += len(part)
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_BIN)


def _first_round(path: str, capacity: int, full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(path), _Writer(0, full)
        items: list[tuple[int, list[dict]]] = []
        for batch in batches:
            release()
            for first, texts in slices(batch.column(1), SLICE_BYTES):
                ids, bounds = encoder.encode(texts)
                doc_ids = batch.column(0).slice(first, len(texts)).to_pylist()
                for doc_id, a, b in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        items.append((len(part), [{"doc_id": doc_id, "piece": piece, "start": start, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes()), "offset": 0}]))
                    if len(items) >= PIECES_AT_ONCE:
                        bins = _merged(items, capacity)
                        yield from writer.batches([x for x in bins if x[0] >= full])
                        items = [x for x in bins if x[0] < full]
                        if len(items) >= PIECES_AT_ONCE // 2:
                            yield from writer.batches(items)
                            items = []
        yield from writer.batches(_merged(items, capacity))
        items.clear()
        release()

    return run


def _later_round(level: int, capacity: int, full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(n, m) for b in batches for n, m in zip(b.column("length").to_pylist(), b.column("members").to_pylist(), strict=True)]
        yield from _Writer(level, full).batches(_merged(items, capacity))
        items.clear()
        release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Place every text's tokens in sequences of at most ``capacity``.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.  A text's ids end with one id 0; only longer ones are
    cut, into pieces of ``capacity``.

    Null and empty texts are the single id 0.  A null id is kept.  Repeated rows
    are packed each for itself.  An empty table gives an empty result.  Other
    columns of ``docs`` are ignored, whatever their names.
    """
    full = max(1, int(capacity * NEARLY_FULL))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = materialize(rows.mapInArrow(_first_round(tokenizer_path, capacity, full), BIN))
    packed, parts = done.where("closed"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, before = done.where("NOT closed"), None
    for level in range(1, 16):
        n = left.count()
        parts = max(-(-parts // FAN_IN), -(-n // BINS_PER_TASK), 1)
        if n <= 1 or before is not None and parts >= before[1] and n > 0.98 * before[0]:
            break
        before = (n, parts)
        done = materialize(left.repartition(parts).mapInArrow(_later_round(level, capacity, full), BIN))
        packed, left = packed.unionByName(done.where("closed")), done.where("NOT closed")
        if parts == 1:
            break
    return packed.unionByName(left).select(F.col("bin_id").alias("sequence_id"), F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
