import os
import random
from collections import Counter, defaultdict

import pytest

from millrace.llm.near_dedup import MATCHES, components, near_duplicates, retain


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k]:
                both = len(sets[i] & sets[k])
                if 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                    root[max(find(i), find(k))] = min(find(i), find(k))
    ids = [r[0] for r in rows]
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), low[find(i)]) for i in range(len(rows))}


def fixture(prose):
    rnd = random.Random(4)
    rows = [(i, prose(i, rnd.randint(1, 90))) for i in range(60)]
    for group in range(6):
        base = prose(1000 + group, 120).split()
        for k in range(15):
            own = list(base)
            for _ in range(rnd.randint(0, 12)):
                own[rnd.randrange(len(own))] = f"w{rnd.random()}"
            rows.append((100 + group * 20 + k, " ".join(own)))
    rows += [(900 + i, prose(3, 50).upper()) for i in range(5)] + [(950, None), (951, ""), (952, " \n\t"), (953, "one"), (954, "ONE"), (955, "one two")]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark, docs, prose):
    rows = fixture(prose)
    for size in (2, 5):
        out = {r.doc_id: r for r in near_duplicates(docs(rows), size=size).collect()}
        for doc_id, (n, low) in brute(rows, size, 80).items():
            assert (out[doc_id].n_shingles, out[doc_id].component_id) == (n, low), (size, doc_id)
            assert out[doc_id].kept == (doc_id == low)


def test_edge_rows(spark, docs):
    out = near_duplicates(docs([(2, "a b c"), (2, "a b c"), (1, "A b c"), (None, "a b c"), (7, None)]), size=2)
    found = sorted((r.doc_id or 0, r.component_id, r.kept) for r in out.collect())
    assert found == [(0, 1, None), (1, 1, True), (2, 1, False), (2, 1, False), (7, 7, True)]
    assert near_duplicates(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(n)], "a binary, b binary")
    out = components(edges).collect()
    assert len(out) == n + 1 and {bytes(r.root) for r in out} == {b"0000"}


def test_many_rows_in_one_batch(spark, docs):
    rows = [(i, f"word{i} other{i} third{i} fourth{i}") for i in range(1200)]
    out = near_duplicates(docs(rows).coalesce(1)).select("doc_id", "kept").collect()
    assert len(out) == 1200 and all(r.kept for r in out)


def links(rows, size, percent):
    """All links of whole texts, by an inverted index of all shingles."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    holders, out = defaultdict(list), set()
    for i, own in sets.items():
        both = Counter(k for x in own for k in holders[x])
        out |= {(k, i) for k, n in both.items() if 100 * n >= percent * (len(own) + len(sets[k]) - n)}
        for x in own:
            holders[x].append(i)
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
@pytest.mark.parametrize("size", [2, 5])
def test_recall_on_all_documents(spark, size):
    """Every link that brute force finds among all 1,000 documents joins a component, and no other does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, size=size).collect()}
    wanted = links(rows, size, 80)
    joined = sum(found[a] == found[b] for a, b in wanted)
    assert len(wanted) > 50 and joined == len(wanted)
    root = {i: i for i, _ in rows}
    for a, b in sorted(wanted):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert found == root


def test_pairs_are_retained_by_their_collisions(spark):
    own = {b"a": [1, 2, 3, 4, 5], b"b": [3, 4, 5, 6], b"c": [5, 6, 7], b"d": [8, 9, 10]}
    lists = spark.createDataFrame(list(own.items()), "node binary, own array<bigint>")
    pairs = [(x, y, found) for x in own for y in own if x < y for found in (0,)] + [(b"c", b"d", MATCHES)]
    out = retain(spark.createDataFrame(pairs, "a binary, b binary, found bigint"), lists).collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in out) == [(b"a", b"b"), (b"c", b"d")]


def test_components_of_a_hub(spark):
    edges = spark.range(1, 3000).selectExpr("cast('0' as binary) AS a", "cast(lpad(cast(id as string), 6, '0') as binary) AS b")
    out = components(edges).collect()
    assert len(out) == 3000 and {bytes(r.root) for r in out} == {b"0"}


def test_a_very_long_text(spark, docs, prose):
    text = prose(1, 60_000)
    out = {r.doc_id: r for r in near_duplicates(docs([(1, text), (2, text.upper()), (3, text + " end"), (4, "else")])).collect()}
    assert [out[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4] and out[1].n_shingles > 50_000
