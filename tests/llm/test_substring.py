import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import substring_dedup as sd
from millrace.llm.cover_sort import PADDING, equal_classes
from millrace.llm.queries import op2_substring_dedup


def brute(rows):
    """Removed spans and kept bytes, by a set of all strings before."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            else:
                seen.add(data[i : i + 100])
        out.append((bytes(b for b, m in zip(data, mark) if not m), sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))))
    return out


def test_cover_sort():
    rnd = random.Random(3)
    for alphabet in (b"a", b"ab", b"abcdefghij", bytes(range(256))):
        base = bytes(rnd.choice(alphabet) for _ in range(700))
        base = base + base[:400] + base
        data = np.zeros(len(base) + PADDING, dtype=np.uint8)
        data[: len(base)] = np.frombuffer(base, dtype=np.uint8)
        starts, classes = equal_classes(data, len(base), np.array(rnd.sample(range(len(base) - 100), 600)), 100)
        heads = [base[i : i + 100] for i in starts]
        assert heads == sorted(heads)
        assert all((heads[i] == heads[i - 1]) == (classes[i] == classes[i - 1]) for i in range(1, len(heads)))


def fixture(prose):
    rnd = random.Random(2)
    passage = " ".join(prose(99, 70).split())
    rows = [(i, prose(i, rnd.randint(5, 120))) for i in range(40)]
    rows += [(100 + i, prose(i, 40) + " " + passage + " " + prose(500 + i, 30)) for i in range(25)]
    rows += [(200 + i, prose(7, 100)) for i in range(12)]
    rows += [(300 + i, prose(8, 100).replace("fox", f"cat{i}")) for i in range(20)]
    rows += [(400, "ab" * 400), (401, "é漢" * 150), (402, "x" * 99), (403, None), (404, ""), (405, passage + passage), (406, "a" * 20_000)]
    return rows


def test_against_brute_force(spark, docs, prose):
    rows = fixture(prose)
    out = {r.doc_id: r for r in sd.remove_repeats(docs(rows).repartition(5)).collect()}
    for (doc_id, text), (kept, spans) in zip(rows, brute(rows)):
        r = out[doc_id]
        assert (bytes(r.kept), len(r.spans), r.n_bytes) == (kept, spans, len((text or "").encode())), doc_id


SMALL = {"block": 50, "block_bytes": 4000, "bucket": 500, "bucket_text": 8000}


@pytest.mark.parametrize("more", [{}, {"hot_in_block": 2}, {"hot": 3}, {"hot_in_block": 0, "hot": 0}, {"block": 300, "hot_in_block": 5, "hot": 10}, {"fan": 3}, {"fan": 2, "hot_in_block": 2, "hot": 3}])
def test_small_blocks_and_hot_anchors(spark, docs, prose, more):
    rows = fixture(prose)
    out = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(docs(rows).repartition(3), limits=sd.Limits(**SMALL | more)).collect()}
    assert [out[i] for i, _ in rows] == [k for k, _ in brute(rows)]


def test_parts_of_a_long_text(prose):
    data = prose(1, 3000).encode()
    anchors = sd.Hasher(1).anchors
    whole = anchors(np.frombuffer(data, dtype=np.uint8))
    assert (whole[3][0], whole[4][-1]) == (0, len(data) - 100)
    assert all(whole[3][1:] == whole[4][:-1] + 1)
    for size in (101, 1000, 5000):
        starts = [at + i for at, part in sd.parts(data, size) for a, b in zip(*anchors(part)[3:]) for i in range(a, b + 1)]
        assert starts == list(range(len(data) - 99))


def test_edge_rows(spark, docs, prose):
    text = prose(1, 60)
    out = sd.remove_repeats(docs([(5, text), (5, text), (None, text), (6, text)]))
    found = sorted((r.doc_id if r.doc_id is not None else -1, len(r.kept)) for r in out.collect())
    assert found == [(-1, len(text)), (5, 0), (5, 0), (6, 0)]
    assert sd.remove_repeats(docs([(5, text), (5, text)])).agg(F.sum(F.octet_length("kept"))).first()[0] == 2 * len(text)
    assert sd.remove_repeats(docs([])).count() == 0
    low = sd.remove_repeats(docs([(-(2**63), text), (None, prose(2, 60)), (2**63 - 1, text)])).collect()
    assert {(r.doc_id, len(r.kept) > 0) for r in low} == {(-(2**63), True), (None, True), (2**63 - 1, False)}


def test_a_text_of_more_than_one_part(spark, docs, prose):
    own = prose(1, 400_000)
    assert len(own) > sd.PART / 2
    passage = prose(5, 100)
    text = own + passage + prose(6, 500_000) + passage + own[:300]
    assert len(text) > sd.PART
    rows = [(1, text), (2, prose(7, 50) + own[-500:] + prose(8, 50))]
    out = {r.doc_id: r for r in sd.remove_repeats(docs(rows)).collect()}
    for (doc_id, text), (kept, spans) in zip(rows, brute(rows)):
        assert bytes(out[doc_id].kept) == kept and len(out[doc_id].spans) == spans and len(kept) < len(text)


def test_buckets_in_two_passes():
    buckets = sd.Buckets(10_000_000, 4096)
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 50_000, dtype=np.uint64)
    assert len(np.unique(buckets.of(hashes))) <= 4096 and (buckets.of(hashes, True) % 4096 == buckets.of(hashes)).all()
    dealt = list(sd._present(buckets.of(hashes, True), hashes))
    assert sum(len(rows) for _, rows in dealt) == len(hashes) and len(dealt) < len(hashes) + 1


def test_query(spark, docs, prose, tmp_path):
    docs(fixture(prose)).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_substring_dedup(spark, str(tmp_path)).filter("n_removed > 0").count() > 50
