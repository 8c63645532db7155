"""MinHash near-dedup by an inverted join of signature coordinates.

Each distinct shingle set is posted under the (coordinate, value) pairs of its MinHash
signature. Two sets whose signatures agree in MATCHES coordinates share one of the rarest
``repeated - MATCHES + 1`` of their postings, so only this prefix is joined, and a set with
fewer repeated postings is skipped. The collisions of each pair that meets in a list are
counted: first those in the joined prefixes; a pair that has MATCHES of them is through, for
the others the rest of the postings is merged. Pairs with MATCHES collisions or more are
retained, all others dropped, and the retained ones are confirmed on the full sets.

A posting list isn't expanded into all pairs: its most connected set is compared with the
others first, and sets that are in one component by then need no further comparison. Which
pairs are still to be compared in lists that hold several components is found by a prefix
join of their sets' shingles; these pairs' collisions are counted like those of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialize

#: A coordinate's value joins GROUP MinHash values, so unrelated documents of a large corpus
#: hardly share one (a list of a single value grows with the corpus, and its pairs with the
#: square of it); at a similarity of 0.8 it agrees with a probability of 0.8**4 = 0.41.
#: Such a pair has fewer than 3 matches in 32 coordinates with a probability of 1.3e-5.
GROUP, COORDINATES, MATCHES = 4, 32, 3
#: Words whose hashes a Python worker remembers.
WORD_MEMORY = 60_000
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 64, COORDINATES * GROUP, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, COORDINATES * GROUP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII blanks."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(tokens: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of the whole sequence if it is shorter."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    size = min(size, len(tokens))
    n = len(tokens) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ codes[k : k + n]) * _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The values of all coordinates; each also hashes its coordinate's number."""
    lows = np.full(COORDINATES * GROUP, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        lows = np.minimum(lows, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    lows >>= np.uint64(32)
    out = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    for k in range(GROUP):
        out = (out ^ lows[k::GROUP]) * _MIX[k]
        out ^= out >> np.uint64(31)
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, node, n_shingles, tokens, payload)``: node names the set, payload holds its words."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("node", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                nodes, counts, tokens, payloads = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = words(text)
                    shingles = shingle_set(own, size)
                    counts.append(len(shingles))
                    full = len(shingles) > 0
                    nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if full else None)
                    tokens.append(signature(shingles).view(np.int64) if full else None)
                    payloads.append(pack(b" ".join(own)) if full else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(payloads, pa.binary())], schema.names
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _postings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(token, node, score)``: each set's prefix of its repeated postings, rarest first; and ``(node, own)``, all of them.

    ``score`` sums the lengths of the set's posting lists: how connected it is.
    """
    posted = nodes.select("node", F.explode("tokens").alias("token"))
    # Written first: joined with an exchange of its own, a long list can be split.
    lengths = materialize(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lengths")
    repeated = posted.join(lengths, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    score = F.aggregate("own", F.lit(0).cast("bigint"), lambda total, x: total + x["n"])
    repeated = materialize(repeated.filter(F.size("own") >= MATCHES).select("node", score.alias("score"), F.col("own.token").alias("own")), "collisions")
    prefix = F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))
    return repeated.select(F.explode(prefix).alias("token"), "node", "score"), repeated.select("node", "own")


def retain(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b, found)`` whose signatures collide in MATCHES coordinates or more.

    ``found`` counts the collisions met so far; only pairs that need more are merged.
    """
    of_a = lists.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    of_b = lists.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    merged = pairs.filter(F.col("found") < MATCHES).join(of_a, "a").join(of_b, "b").filter(F.size(F.array_intersect("own_a", "own_b")) >= MATCHES)
    return pairs.filter(F.col("found") >= MATCHES).select("a", "b").unionAll(merged.select("a", "b"))


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``100 * intersection >= percent * union``."""

    @F.arrow_udf(T.BooleanType())
    def linked(one: pa.Array, other: pa.Array) -> pa.Array:
        unpack, known = zstandard.ZstdDecompressor().decompress, {}

        def full_set(payload: bytes) -> np.ndarray:
            if payload not in known:
                if len(known) >= 64:
                    known.clear()
                known[payload] = shingle_set(unpack(payload).split(), size)
            return known[payload]

        out = []
        for p, q in zip(one, other):
            x, y = full_set(p.as_py()), full_set(q.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    of_a = texts.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("payload").alias("text_a"))
    of_b = texts.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("payload").alias("text_b"))
    sized = pairs.join(of_b, "b").join(of_a, "a").filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
    return sized.filter(linked(F.col("text_a"), F.col("text_b"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a, b)``; root is the component's smallest node.

    Every round links each node with the smallest node among its neighbours (large star, small
    star), which halves distances at least. Edges and smallest nodes are written to the shared
    folder in each round: a join with a written table can be split at nodes with many neighbours.
    """

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    now = state(current)
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        current, before = materialize(small.filter("u <> v").distinct(), "edges"), now
        now = state(current)
        if now == before:
            break
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _labelled(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings with their set's component, only of lists that hold two components or more."""
    label: Column = F.col("node")
    if roots is not None:
        postings = postings.join(roots, "node", "left")
        label = F.coalesce("root", "node")
    found = postings.select("token", "node", "score", label.alias("label"))
    mixed = found.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("score", "node", "label")).alias("top")).filter("low <> high")
    # Written first: joined with an exchange of its own, a long list can be split.
    mixed = materialize(mixed.select("token", "top"), "mixed")
    return materialize(found.join(mixed, "token"), "postings")


def _crossing(labelled: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Every pair ``(a, b)`` of sets in different components that can be similar enough.

    Sets that share postings but aren't linked (edited copies of one text, say) would give
    as many pairs as their square. So their shingles are posted instead, again only the
    rarest: two similar sets share one of the ``n - ceil(percent * n / 100) + 1`` rarest of
    each. Exact, and short, since an edit makes shingles that no other set has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                sets = [shingle_set(unpack(p.as_py()).split(), size) for p in part.column(2)]
                index = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                columns = [part.column(i).take(index) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(sets).view(np.int64))], ["node", "label", "n", "shingle"])

    held = labelled.join(texts, "node").select("node", "label", "payload", F.col("n_shingles").alias("n"))
    posted = materialize(held.mapInArrow(run, "node binary, label binary, n bigint, shingle bigint"), "shingles")
    counts = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("of")).filter("of > 1")
    repeated = posted.join(counts, "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("of", "shingle"))).alias("own"))
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    left = (prefix - (F.col("n") - F.size("own"))).cast("int")
    prefixes = repeated.filter(left > 0).select("node", "label", "n", (F.col("n") - F.size("own")).alias("alone"), F.posexplode(F.slice("own", F.lit(1), left)).alias("at", "p"))
    prefixes = prefixes.select(F.col("p.shingle").alias("shingle"), "node", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
    one = prefixes.select(F.col("shingle").alias("s"), F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    other = prefixes.select(F.col("shingle").alias("t"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    # From the first shared shingle on, the rest of each set has to hold the whole intersection.
    enough = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    return one.join(other, (F.col("s") == F.col("t")) & (F.col("la") < F.col("lb")) & enough).select("a", "b")


def _counted(pairs: DataFrame) -> DataFrame:
    """``(a, b, found)``: each pair once, with how many lists it was met in."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("found"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are lower-cased (A-Z) and split at blanks; a document's set holds its distinct
    ``size``-word shingles, or its whole sequence if it has fewer words. Documents are linked
    if ``100 * intersection >= percent * union``, and ``component_id`` is the smallest id that
    can be reached. Texts that are null, empty or blank have an empty set and link with
    nothing. Equal sets are handled once, whatever their number. Rows with a null id keep a
    null ``kept`` if they are alone; repeated rows share a component and, having the smallest
    id, are all kept. Texts of any length are read whole, one at a time. Other columns are not
    read. An empty table gives an empty one.
    """
    rows = materialize(_sets(docs, id_col, text_col, size), "sets")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    nodes = materialize(nodes, "nodes")
    postings, lists = _postings(nodes)
    postings = materialize(postings, "postings")
    # Copies are reduced to one before the shuffle.
    texts = rows.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("payload").alias("payload"))
    texts = materialize(texts.join(lists.select("node"), "node", "left_semi"), "texts")

    # Each list's most connected set against the rest.
    listed = _labelled(postings, None)
    tried = materialize(_counted(listed.filter(F.col("top.node") != F.col("node")).select(F.col("top.node").alias("a"), F.col("node").alias("b"))), "pairs")
    edges = materialize(confirm(retain(tried, lists), texts, size, percent), "links")
    roots = components(edges)
    # Then that of the list's second component, and last whatever pairs can still join two components.
    for last in (False, True):
        listed = _labelled(postings, materialize(roots, "roots"))
        if last:
            # Its pairs are met by shingles, not in lists: none of their collisions is counted yet.
            pairs = _counted(_crossing(listed.select("node", "label").distinct(), texts, size, percent)).withColumn("found", F.lit(0).cast("bigint"))
        else:
            second = listed.filter(F.col("label") != F.col("top.label")).groupBy("token").agg(F.max(F.struct("score", "node", "label")).alias("next"))
            second = materialize(second, "second")
            pairs = _counted(listed.join(second, "token").filter(F.col("label") != F.col("next.label")).select(F.col("next.node").alias("a"), F.col("node").alias("b")))
        new = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionAll(new)
        edges = materialize(edges.unionAll(confirm(retain(new, lists), texts, size, percent)), "links")
        roots = components(edges)

    named = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = materialize(named.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    named = named.join(smallest, "root").select("node", "component_id")
    joined = rows.select("id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))
