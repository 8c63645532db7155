"""Document fingerprints after I-Match, with DataFrame functions only.

A lexicon keeps the terms whose inverse document frequency lies in a band. A document's
distinct terms in the lexicon are sorted, and each of several randomised subsets of the
lexicon hashes the sorted terms that it holds. The subsets differ in density, so that
short and long documents both have some that hold a few of their terms.

A term is a 64-bit hash. Every random partition of the lexicon reads bits of that hash that
no other partition and no slot of the lexicon's bit map reads, so partitions are independent
of each other; the subsets of one partition are disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: The lexicon is a bit map of fixed size: a term's slot is set if any term there is in the band.
#: In the band are at most (terms of a document) / BAND[0] terms, whatever the corpus.
SLOT_BITS = 22
LEXICON_BITS = 1 << SLOT_BITS
#: Document frequencies of the band, as shares of all documents: 1e-4 to 0.02 is an inverse
#: document frequency of ln 50 to ln 10,000.
BAND = (1e-4, 0.02)
#: Random partitions of the lexicon: bits read (a partition has 2**bits parts), and how many
#: partitions of this kind. Each density, one term in 2**bits, has SUBSETS subsets in all.
PARTITIONS = ((2, 4), (4, 1), (6, 1), (8, 1), (10, 1))
SUBSETS = 16
#: What xxhash64 gives for an empty array: its seed.
EMPTY = 42


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str, band: tuple[float, float] = BAND) -> Column:
    """A constant array: the bit map of the terms in the band, counted over all documents.

    A term needs two documents at least. The map has LEXICON_BITS bits whatever the table's
    size, so it may pass through the driver. (Spark allows no subquery in a lambda function.)
    """
    spark = docs.sparkSession
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    slot = F.pmod("term", F.lit(LEXICON_BITS))
    inside = counts.filter((F.col("df") >= F.greatest(F.lit(2.0), total * band[0])) & (F.col("df") <= F.greatest(F.lit(2.0), total * band[1])))
    longs = inside.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(term, {LEXICON_BITS}) & 63 AS INT))").alias("bits"))
    every = longs.unionAll(spark.range(LEXICON_BITS // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits")))
    rows = every.groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = rows.agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("map")).select(F.array_join("map.bits", ",")).first()[0]
    return F.split(F.lit(found), ",").cast("array<bigint>")


def _masked(terms: Column, mask: int, value: int) -> Column:
    return F.filter(terms, lambda t: t.bitwiseAND(F.lit(mask)) == F.lit(value))


def with_hashes(docs: DataFrame, text_col: str, bits: Column, name: str) -> DataFrame:
    """Adds ``name``: for each subset of the lexicon a 64-bit hash of the text's sorted terms in it.

    Null where a subset holds no term. A text with no term in the lexicon (very short, or of
    another language than the corpus) would have no fingerprint at all, so all its terms count
    instead: equal texts still agree, and its hashes can't meet those of texts inside the band
    but by the same terms. A text without terms has none.

    Each array that several subsets read is a column of its own, computed once: partitions into
    16 parts are split by their first two bits before, sparse ones are read from the few terms
    in their first SUBSETS parts. The hash of no term is the seed, which stands for null.
    """

    def found(t: Column) -> Column:
        slot = F.pmod(t, F.lit(LEXICON_BITS))
        return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1

    df = docs.withColumn("__every", terms(F.col(text_col))).withColumn("__kept", F.filter("__every", found))
    df = df.withColumn("__sorted", F.array_sort(F.when(F.size("__kept") > 0, F.col("__kept")).otherwise(F.col("__every"))))
    coarse, held, shift = {}, [], SLOT_BITS
    for i, (width, times) in enumerate(PARTITIONS):
        for _ in range(times):
            of = F.col("__sorted")
            if 1 << width > SUBSETS:
                coarse[f"__few{i}"] = _masked(of, ((1 << width) - SUBSETS) << shift, 0)
                of = F.col(f"__few{i}")
            for k in range(min(1 << width, SUBSETS // times)):
                if 1 << width == SUBSETS:
                    coarse[f"__part{i}_{k % 4}"] = _masked(F.col("__sorted"), 3 << shift, (k % 4) << shift)
                    of = F.col(f"__part{i}_{k % 4}")
                held.append(F.xxhash64(_masked(of, ((1 << width) - 1) << shift, k << shift)))
            shift += width
    raw = F.array(*held)
    out = df.withColumns(coarse).withColumn(name, F.transform(raw, lambda h: F.when(h != EMPTY, h)))
    return out.drop("__every", "__kept", "__sorted", *coarse)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), "")


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: of the subsets of some density that hold a term of either, the share whose hashes agree.

    The best density counts, since a subset agrees only if the edit hit none of its terms: with
    d changed terms a subset of density 1/2**bits agrees with probability (1 - 2**-bits)**d, so
    dense subsets see small edits of short texts, sparse ones large edits of long texts, and the
    other densities tell nothing about the pair. Fewer than four such subsets count as four: an
    agreement of one or two alone is likely between unrelated texts that share a term. 1 for
    equal fingerprints.
    """
    agree = F.zip_with(one, other, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    either = F.zip_with(one, other, lambda a, b: (a.isNotNull() | b.isNotNull()).cast("int"))

    def total(flags: Column, at: int) -> Column:
        return F.aggregate(F.slice(flags, at + 1, SUBSETS), F.lit(0), lambda x, y: x + y)

    shares = [total(agree, i * SUBSETS) / F.greatest(total(either, i * SUBSETS), F.lit(4)) for i in range(len(PARTITIONS))]
    return F.when(one == other, 1.0).otherwise(F.greatest(*shares))


def previous_keys(keys: DataFrame) -> DataFrame:
    """Adds ``p_id, p_a, p_b, p_n``, the row before, to each row of distinct keys ``(id, a, b, n)``.

    Before the first key comes the last. The keys, without their texts, are dealt into ranges of
    equal size and written to the shared folder; each range is put in order by itself, and its
    first row gets the last one of the range before it, from a table of one row a range. Null
    ids come first; ids may be any integers.
    """
    ranged = materialize(keys.repartitionByRange(F.col("id").asc_nulls_first(), "a", "b").withColumn("range", F.spark_partition_id()), "keys")
    row, within = F.struct("id", "a", "b", "n"), W.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "a", "b")
    place = F.struct(F.col("id").isNotNull().alias("has"), F.coalesce("id", F.lit(0).cast("bigint")).alias("at"), "a", "b")
    ends = ranged.groupBy(F.col("range").alias("of")).agg(F.max_by(row, place).alias("end"))
    every, ring = W.orderBy("of"), W.orderBy("of").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("of", F.coalesce(F.lag("end").over(every), F.last("end").over(ring)).alias("end"))
    led = ranged.withColumn("before", F.lag(row).over(within)).join(ends, F.col("range") == F.col("of"))
    before = F.coalesce("before", "end")
    return led.select("id", "a", "b", *[before[c].alias(f"p_{c}") for c in ("id", "a", "b", "n")])


def _same(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for x, y in zip(left, right):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def with_following(docs: DataFrame, id_col: str, text_col: str, carry: list[str], names: list[str]) -> DataFrame:
    """``docs`` with the columns ``carry`` of the next row by ``id_col`` as ``names``, and ``__next``.

    ``__next`` is as much of the beginning of the next row's text as half of this text is long;
    after the last row comes the first. Equal ids are ordered by 96 bits of hashes of the text; rows
    that agree in id and text count as one row here, and each of them is followed by the next
    different row. Texts must not be null; columns but these are dropped.

    Only keys are put in order. Each text is then shuffled once by its key, and of each the part
    that its predecessor needs a second time; no key gathers other rows than its own copies.
    """
    mine, prior = ("__id", "__a", "__b"), ("p_id", "p_a", "p_b")
    hashed = [F.col(id_col).cast("bigint").alias("__id"), F.xxhash64(text_col).alias("__a"), F.hash(text_col).alias("__b")]
    keys = docs.select(*hashed, F.length(text_col).alias("n")).groupBy(*mine).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    keys = materialize(keys.select(*[F.col(c).alias(c[2:]) for c in mine], "n", "rows"), "rows")
    before = materialize(previous_keys(keys.drop("rows")), "before")
    own = docs.select(*hashed, F.col(text_col), *carry)
    copies = own.join(before, _same(mine, ("id", "a", "b"))).select(*prior, F.substring(text_col, F.lit(1), F.floor(F.col("p_n") / 2).cast("int")).alias("__next"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    if not keys.filter("rows > 1").isEmpty():
        copies = copies.dropDuplicates(list(prior))
    led = own.join(copies, _same(mine, prior))
    return led.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), text_col, *carry, "__next", *names)


def fingerprints(docs: DataFrame, bits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hashes array<bigint>, fingerprint string)`` for each row of ``docs``; no shuffle.

    A null text counts as empty; a text without terms has no hash. Equal texts have equal
    fingerprints. Repeated rows and null ids each get a row; other columns are not read.
    """
    found = with_hashes(docs.select(id_col, F.col(text_col).alias("__text")), "__text", bits, "hashes")
    return found.select(id_col, "hashes").withColumn("fingerprint", as_text(F.col("hashes")))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """How fingerprints stand up to edits: one row for each row of ``docs``.

    The edited text has the last ``floor(n/2)`` code points replaced by the first as many (or
    all) of the next row by id; after the last comes the first, so a single row follows itself.
    Ids are any integers; null ids come first, equal ids and repeated rows are ordered as in
    ``with_following``. Null texts count as empty, texts of any length are read whole. Other
    columns are not read. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    bits = lexicon(texts, "__text", band)
    own = with_hashes(texts, "__text", bits, "__hashes")
    led = with_following(own, id_col, "__text", ["__hashes"], ["__next_hashes"])
    n = F.length("__text")
    edited = led.withColumn("n_chars", n.cast("bigint")).withColumn("__edited", F.concat(F.substring("__text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("__next")))
    edited = with_hashes(edited.select(id_col, "n_chars", "__edited", "__hashes", "__next_hashes"), "__edited", bits, "__edited_hashes")
    edited = edited.select(id_col, "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "__hashes", "__next_hashes", "__edited_hashes")
    return edited.select(
        id_col, "n_chars", "edited_sha256",
        as_text(F.col("__hashes")).alias("fingerprint"),
        as_text(F.col("__edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("__hashes"), F.col("__edited_hashes")).alias("near_edited"),
        likeness(F.col("__hashes"), F.col("__next_hashes")).alias("near_next"),
    )
