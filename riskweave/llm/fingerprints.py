"""Operator 3, document fingerprints by I-Match over randomised lexicons.

Terms are lower-cased runs of letters and digits.  The lexicon holds the terms
whose inverse document frequency lies in a band.  Each of several subsets of the
lexicon, drawn by hashing terms, keeps a fixed share of it; a text's distinct
terms of one subset, sorted, are hashed to one part of its fingerprint.  Texts
are alike by the share of parts on which they agree.

The lower end of the band bounds the lexicon: if a term must be in a share f of
all documents, at most (distinct terms of a mean document) / f terms can be, so
the lexicon may be broadcast at any size of corpus.  Everything is built-in
column functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.text import bound
from riskweave.llm.storage import cleared, kept, materialize

#: Terms kept: those in at least this and at most that share of the documents.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2
#: Share of the lexicon that each subset keeps; small ones tell long texts apart, large ones short texts.
SUBSETS = (1 / 2, 1 / 4, 1 / 8, *[1 / 16] * 3, *[1 / 32] * 4, *[1 / 64] * 4, *[1 / 128] * 4, *[1 / 256] * 5, *[1 / 512] * 5)
#: Documents of neighbouring ids that one group of the neighbour search holds, about, and bounds at most.
GROUP_ROWS, MOST_GROUPS = 400, 1 << 14
TERM_BREAK = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), TERM_BREAK)), "")


def lexicon_of(docs: DataFrame, *, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Terms of the band with their idf and, as bits of one number, the subsets that keep them."""
    n = docs.count()
    terms = docs.select(F.explode(terms_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = counts.where((F.col("df") >= least * n) & (F.col("df") <= max(most * n, 1.0)))
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("term"))), 1, 5), 16, 10).cast("int")
    bits = reduce(lambda a, b: a + b, [F.when(drawn(k) < int(share * (1 << 20)), 1 << k).otherwise(0) for k, share in enumerate(SUBSETS)])
    return materialize(kept.select("term", F.log(F.lit(float(n)) / F.col("df")).alias("idf"), bits.cast("int").alias("subsets")))


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, by halving."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda low, step: F.when((low + step <= len(cuts)) & (F.get(bounds, low + step - 1) < value), low + step).otherwise(low),
    )


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, row (together a key), doc_id, text, next_text, next_part and next_row; next by descending id, the first after the last.

    Ids are cut into ranges of about equal numbers of rows, and texts are dealt
    out once, by range; the first document of each range also goes to the end of
    the range before it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    groups = max(1, min(MOST_GROUPS, rows.count() // GROUP_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / groups for k in range(1, groups)] or [0.5], min(100 * groups, 1_000_000))).first()[0] or []
    tie = F.xxhash64("text")
    # Rows without an id come after the others, the largest hash of the text first, in ranges of equal shares of the hashes.
    unnamed = F.least(F.floor((0.5 - tie / F.lit(2.0**64)) * groups), F.lit(groups - 1)).cast("int")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1 - unnamed).otherwise(_place(F.col("doc_id"), sorted(set(cuts)))))
    firsts = materialize(rows.groupBy("part").agg(F.max(F.struct("doc_id", tie.alias("tie"), "text")).alias("f")))
    # One number for each range: at most MOST_GROUPS with and as many without ids.
    numbers = [r[0] for r in firsts.select("part").orderBy(F.desc("part")).collect()]
    before = F.create_map(*[F.lit(x) for a, b in zip(numbers, [numbers[-1], *numbers[:-1]], strict=True) for x in (a, b)]) if numbers else F.create_map().cast("map<int,int>")
    ends = firsts.select("f.doc_id", "f.text", F.element_at(before, F.col("part")).alias("part"), F.lit(1).alias("end"), F.col("part").alias("own"))
    order = Window.partitionBy("part").orderBy("end", F.col("doc_id").desc_nulls_last(), tie.desc())
    nxt = lambda c: F.lead(c).over(order)
    return (
        rows.select("doc_id", "text", "part", F.lit(0).alias("end"), F.col("part").alias("own"))
        .unionByName(ends)
        .select("*", F.row_number().over(order).alias("row"), nxt("text").alias("next_text"), nxt("own").alias("next_part"), nxt("end").alias("next_end"))
        .where("end = 0")
        .select("part", "row", "doc_id", "text", "next_text", "next_part", F.when(F.col("next_end") == 1, 1).otherwise(F.col("row") + 1).alias("next_row"))
    )


def fingerprints_of(texts: DataFrame, lexicon: DataFrame, keys: list[str], columns: list[str], others: list[str] | None = None) -> DataFrame:
    """``keys``, which name a row, ``others``, and the fingerprint of each text column under its own name.

    Terms are exploded in place and met with the broadcast lexicon; a row's terms
    stay in its task, where those of the lexicon come together again.  They are
    sorted once; of each subset the terms that it keeps are hashed in this order.
    """
    # The empty term stands for every text, so that none is lost in the join.
    known = lexicon.select("term", "subsets").unionByName(lexicon.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).alias("subsets")))
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.array_append(terms_of(F.col(c)), F.lit("")).alias("terms")) for i, c in enumerate(columns)])
    names = [*(others or []), *[f"_whole{i}" for i in range(len(columns))]]
    own = F.struct(*[F.col(c).alias(c) for c in names]).alias("_own")
    spread = texts.withColumns({f"_whole{i}": F.md5(F.col(c)) for i, c in enumerate(columns)}).select(*keys, own, F.explode(each).alias("x")).select(*keys, "_own", "x.kind", F.explode("x.terms").alias("term"))
    # What else a row has travels with its empty term only, so that the rows of terms stay narrow.
    spread = spread.withColumn("_own", F.when(F.col("term") == "", F.col("_own")))
    of = lambda i: F.array_sort(F.collect_list(F.when((F.col("kind") == i) & (F.col("subsets") > 0), F.struct("term", "subsets"))))
    met = spread.join(F.broadcast(known), "term").groupBy(*keys).agg(F.first("_own", ignorenulls=True).alias("_own"), *[of(i).alias(f"_terms{i}") for i in range(len(columns))])

    def part(terms: Column, k: int) -> Column:
        own = F.transform(F.filter(terms, lambda x: x["subsets"].bitwiseAND(1 << k) > 0), lambda x: x["term"])
        # Terms are letters and digits, so the joined text is that of one list of terms only.
        return bound(own, lambda x: F.when(F.size(x) > 0, F.left(F.md5(F.array_join(x, " ")), F.lit(16))).otherwise("_"))

    def written(i: int) -> Column:
        parts = F.array_join(F.array(*[part(F.col(f"_terms{i}"), k) for k in range(len(SUBSETS))]), "-")
        return bound(parts, lambda x: F.when(x.rlike("^[_-]*$"), F.concat(F.lit("="), F.col(f"_own._whole{i}"))).otherwise(x))

    return met.select(*keys, *[F.col(f"_own.{c}").alias(c) for c in others or []], *[written(i).alias(c) for i, c in enumerate(columns)])


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts that either fingerprint has on which both agree; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    there = F.filter(pairs, lambda x: ~((x["a"] == "_") & (x["b"] == "_")))
    same = F.filter(there, lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    return F.when(a == b, 1.0).otherwise(F.size(same) / F.size(there))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    Returns one row for each row of ``docs``: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.  The edited text has
    the last third replaced by the beginning of the next document.

    Null texts are empty texts.  Rows with a null id come last, by falling hash
    of their text.
    Repeated rows are each other's neighbours and stay separate.  A table of one
    row is its own next document; an empty table gives an empty result.  Other
    columns are ignored.
    """
    with cleared():
        return _fingerprinted(docs, id_col, text_col, least, most)


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str, least: float, most: float) -> DataFrame:
    lexicon = lexicon_of(docs, text_col=text_col, least=least, most=most)
    near = with_next(docs, id_col=id_col, text_col=text_col).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), (F.col("n_chars") - third).cast("int")), F.left(F.col("next_text"), third))
    near = near.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys, others = ["part", "row"], ["doc_id", "n_chars", "edited_sha256", "next_part", "next_row"]
    prints = fingerprints_of(near.select(*keys, *others, F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint")), lexicon, keys, ["fingerprint", "edited_fingerprint"], others)
    prints = kept(prints)
    following = prints.select(F.col("part").alias("next_part"), F.col("row").alias("next_row"), F.col("fingerprint").alias("next_fingerprint"))
    return prints.join(following, ["next_part", "next_row"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )
