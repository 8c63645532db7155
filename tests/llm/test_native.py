import hashlib
import json
import os
import random
import struct
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import regex as re
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chat_format, mixing
from millrace.llm.bpe import encode_documents
from millrace.llm.fingerprint import compare_edits, previous_keys, with_following
from millrace.llm.line_dedup import ORACLE as LINES
from millrace.llm.line_dedup import drop_boilerplate


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return sorted(str(tuple(v for _, v in sorted(zip(names, row)))) for row in cursor.fetchall())


def here(df):
    names = sorted(df.columns)
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in ("Python", "Pandas", "Arrow") if w in plan]


def test_fingerprints(spark, docs, prose):
    rows = [(i, prose(i, 80)) for i in range(0, 60, 2)] + [(61, prose(2, 80)), (70, None), (71, ""), (72, "!!"), (73, "x" * 50_000), (74, "é漢🎉 ab")]
    df = docs(rows)
    out = {r.doc_id: r for r in compare_edits(df).collect()}
    texts = [t or "" for _, t in rows]
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", texts[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert out[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[doc_id].n_chars == len(text)
        assert 0 <= out[doc_id].near_edited <= 1 and 0 <= out[doc_id].near_next <= 1
    assert out[2].fingerprint == out[61].fingerprint != out[4].fingerprint
    assert out[70].fingerprint == out[71].fingerprint and out[70].near_next == 1.0
    near = [out[i].near_edited > out[i].near_next for i in range(0, 58, 2)]
    assert sum(near) > len(near) * 0.8
    assert not python_nodes(compare_edits(df))
    assert compare_edits(docs([])).count() == 0
    assert compare_edits(docs([(5, "alone")])).first().near_next == 1.0


def test_fingerprints_find_most_edits(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    found = compare_edits(spark.read.parquet(f"{folder}/documents.parquet")).select("near_edited", "near_next").collect()
    assert sum(r.near_edited > r.near_next for r in found) >= 0.94 * len(found)
    assert sum(r.near_edited == 0 for r in found) <= 0.06 * len(found)


def plain_hash(values):
    """Spark's xxhash64 of an array: each element's hash seeds the next one."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h


def plain_terms(text):
    words = {w for w in re.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    return {struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), seed=42)))[0] for w in words}


def plain_fingerprint(text, slots):
    found = plain_terms(text)
    found = sorted({t for t in found if t % (1 << 22) in slots} or found)
    out, shift = [], 22
    for bits, times in ((2, 4), (4, 1), (6, 1), (8, 1), (10, 1)):
        for _ in range(times):
            for k in range(min(1 << bits, 16 // times)):
                held = [t for t in found if (t % (1 << 64) >> shift) % (1 << bits) == k]
                out.append(f"{plain_hash(held):016x}" if held else "-")
            shift += bits
    return out


def plain_likeness(one, other):
    if one == other:
        return 1.0
    best = 0.0
    for at in range(0, 80, 16):
        pairs = list(zip(one[at : at + 16], other[at : at + 16]))
        best = max(best, sum(x == y != "-" for x, y in pairs) / max(sum(x != "-" or y != "-" for x, y in pairs), 4))
    return best


def test_fingerprints_equal_a_plain_version(spark, docs, prose):
    rnd = random.Random(8)
    rows = [(rnd.randrange(-(2**63), 2**63), prose(i % 70, rnd.randint(1, 150)) + f" é漢{i % 9}") for i in range(150)]
    rows += [(2**63 - 1, "edge of the ids"), (-(2**63), "other edge"), (7, "!!"), (8, None), (9, ""), (10, "alone " * 30_000 + prose(5, 60)), (11, "unheardof wordsonly"), (None, prose(3, 50))]
    rows += [(12, prose(1, 40)), (12, prose(2, 40)), (12, prose(2, 40)), (None, prose(4, 60))]
    texts = sorted(dict.fromkeys((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, *key_hashes(r[1])))
    df = Counter(t for _, text in rows for t in plain_terms(text or ""))
    low, high = max(2, 1e-4 * len(rows)), max(2, 0.02 * len(rows))
    slots = {t % (1 << 22) for t, n in df.items() if low <= n <= high}
    following = {r: texts[(k + 1) % len(texts)][1] for k, r in enumerate(texts)}
    found = compare_edits(docs(rows).repartition(5)).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id, r.edited_sha256): r for r in found}
    for doc_id, text in texts:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[(doc_id, text)][:half]
        r = got[(doc_id, hashlib.sha256(edited.encode()).hexdigest())]
        own, theirs, after = (plain_fingerprint(x, slots) for x in (text, edited, following[(doc_id, text)]))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), "".join(own), "".join(theirs))
        assert abs(r.near_edited - plain_likeness(own, theirs)) < 1e-12 and abs(r.near_next - plain_likeness(own, after)) < 1e-12


def key_hashes(text):
    signed = lambda v, size, code: struct.unpack(code.lower(), struct.pack(code, v))[0]
    return (signed(xxhash.xxh64_intdigest(text.encode(), seed=42), 8, "<Q"),)


def test_following_over_many_ranges(spark):
    ids = [i * i for i in range(3000)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none"), (2**62, "far")], "doc_id bigint, text string")
    out = with_following(df, "doc_id", "text", ["text"], ["next"]).select("doc_id", "text", "next", "__next").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 3002 and got[None].next == "t0" and got[ids[-1]].next == "far" and got[2**62].next == "none"
    assert all(got[a].next == f"t{b}" and got[a]["__next"] == f"t{b}"[: len(f"t{a}") // 2] for a, b in zip(ids, ids[1:]))


def test_ranges_of_keys_are_even(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") == 5, F.lit(2**60)).otherwise(F.col("id")).alias("id"), F.col("id").alias("a"), F.lit(0).alias("b"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = keys.repartitionByRange(F.col("id").asc_nulls_first(), "a", "b").groupBy(F.spark_partition_id()).count()
        assert ranged.agg(F.max("count")).first()[0] < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = previous_keys(keys)
    assert out.count() == 20_000 and out.filter(F.col("id") == 2**60).first().p_id == 19_999 and out.filter("id = 0").first().p_id == 2**60


def test_line_dedup(spark, docs):
    menu = "Home | About"
    rows = [(i, f"{menu}\nown line {i}\n\nshared by two {i // 2}", "a") for i in range(200)] + [(500, menu, "b"), (501, None, "b"), (502, "", "b"), (503, menu, None), (503, menu, None), (None, f"{menu}\r\nx", "a"), (504, f"{menu}\n" * 50_000, "a")]
    df = docs(rows)
    out = drop_boilerplate(df)
    got = {r.doc_id: r for r in out.collect()}
    assert got[7].kept_text == "own line 7\n\nshared by two 3" and got[7].n_dropped == 1 and got[7].n_lines == 4
    assert got[500].kept_text == menu and got[501].kept_text is None and got[501].n_lines == 0 and got[502].kept_text == ""
    assert got[503].n_dropped == 0 and got[504].n_dropped == 50_000 and set(df.columns) <= set(out.columns)
    assert not python_nodes(out)
    own = df.select("doc_id", "source", "text")
    assert here(drop_boilerplate(own).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))) == duck(LINES, documents=own)
    assert drop_boilerplate(docs([])).count() == 0


def test_line_dedup_of_rare_lines_and_copies(spark, docs):
    rows = [(i, f"own {i}" + ("\nnotice" if i < 15 else ""), "a") for i in range(300)] + [(1000 + i, "copied one\ncopied two", "a") for i in range(100)]
    pages = {r.doc_id: r for r in drop_boilerplate(docs(rows)).collect()}
    texts = {r.doc_id: r for r in drop_boilerplate(docs(rows), by_text=True).collect()}
    assert len(pages) == len(texts) == 400
    assert all(found[i].kept_text == f"own {i}" for found in (pages, texts) for i in range(15))
    assert pages[1000].n_dropped == 2 and texts[1000].n_dropped == 0 and texts[1099].kept_text == "copied one\ncopied two"
    # 8 of 392 texts, but 8 of 500 pages: copies and repeated nulls leave both numbers.
    rows = [(i, f"own {i}" + ("\nrare" if i < 8 else ""), "a") for i in range(390)] + [(2000 + i, None if i % 2 else "copy", "a") for i in range(110)]
    found = [drop_boilerplate(docs(rows), by_text=flag).agg(F.sum("n_dropped")).first()[0] for flag in (False, True)]
    assert found == [55, 8]


def test_mixing(spark, docs, prose):
    rows = [(i, prose(i, 10 + i % 40), f"src{i % 7}", "en" if i % 3 else "de") for i in range(500)] + [(900, None, "src1", "en"), (901, "", "src1", "en"), (902, "word " * 20_000, "src2", "fr")]
    df = docs(rows)
    for share, epochs in ((0.4, 1), (1.3, 2), (5.0, 3)):
        out = mixing.mix(df, share, epochs)
        own = out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
        assert here(own) == duck(mixing.oracle(share, epochs), documents=df.select("doc_id", "text", "lang", "source"))
    assert not python_nodes(out)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    taken = mixing.mix(df, 0.4).agg(F.sum("n_tokens")).first()[0]
    assert abs(taken - 0.4 * total) < 25_000
    odd = docs([(1, "a b c", None, None), (1, "a b c", None, None), (None, "d e", "s1", "xx")])
    assert mixing.mix(odd, 1.0).count() == 3 and mixing.mix(docs([]), 1.0).count() == 0


def test_mixing_with_clashing_columns_and_own_counts(spark, docs, prose):
    rows = [(i, prose(i, 10 + i % 40), f"src{i % 7}", "en" if i % 3 else "de") for i in range(200)]
    plain = mixing.mix(docs(rows), 0.4).select("doc_id", "epoch")
    more = docs(rows).withColumns({c: F.lit("x") for c in ("whole", "rest", "p_domain", "p_lang", "p_source", "sum", "upto", "start", "tokens", "budget", "weight", "node", "Epoch")})
    out = mixing.mix(more, 0.4)
    assert here(out.select("doc_id", "epoch")) == here(plain) and {"whole", "rest", "p_domain", "tokens"} <= set(out.columns)
    # Counts of its own: every document has one token, and a null has none.
    counted = docs(rows).withColumn("n_bpe", F.when(F.col("doc_id") != 3, F.lit(1)))
    out = mixing.mix(counted, 0.5, tokens="n_bpe", domain="source")
    assert out.agg(F.sum("n_tokens")).first()[0] in range(85, 101) and {r.domain for r in out.select("domain").distinct().collect()} <= {f"src{i}" for i in range(7)}


def test_mixing_by_bpe_tokens(spark, docs, prose):
    rows = [(i, prose(i, 10 + i % 40), f"src{i % 5}", "en") for i in range(60)]
    encoded = encode_documents(docs(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", F.size("ids").alias("n_bpe"))
    total = encoded.agg(F.sum("n_bpe")).first()[0]
    out = mixing.mix(docs(rows).join(encoded, "doc_id"), 0.5, tokens="n_bpe")
    taken = {r.doc_id: r.n_tokens for r in out.collect()}
    assert taken == {r.doc_id: r.n_bpe for r in encoded.collect() if r.doc_id in taken} and 0.5 * total <= sum(taken.values()) + 15 < 0.8 * total


SCHEMAS = {"add": {"a": {"type": "integer", "required": True}, "b": {"type": "number"}, "note": {"type": "string", "max_length": 3}}}


def test_chats(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, call_id string, call_name string, arguments string, result_of string, json string"
    call = lambda turn, cid, args, name="add": (1, turn, "assistant", None, cid, name, args, None, None)
    rows = [
        (1, 0, "system", "Hi \"you\"\n", None, None, None, None, None),
        (1, 1, "tool", "early", None, None, None, "c2", None),
        call(2, "c1", '{"b": 1.5, "a": 1}'), call(3, "c2", '{"a": "x"}'), call(4, "c3", "nonsense"), call(5, "c4", '{"a": 1, "z": 2}'), call(6, "c5", '{"a": 1, "note": "long!"}'), call(7, "c6", '{"a":1}', "other"), call(8, "c7", None),
        (1, 9, "tool", "1", None, None, None, "c1", None), (1, 10, "tool", "?", None, None, None, "c99", None), call(11, "c1", '{"a": 3}'),
        (None, 0, "tool", "x", None, None, None, "c1", None), (2, 0, "user", None, None, None, None, None, None), (2, 0, "user", None, None, None, None, None, None),
    ]
    out = chat_format.format_chats(spark.createDataFrame(rows, schema), SCHEMAS)
    assert not python_nodes(out)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[(1, 2)].valid and got[(1, 2)].link == "call" and '"arguments":{"a":1,"b":1.5}' in got[(1, 2)].json
    assert [got[(1, t)].valid for t in range(3, 9)] == [False] * 6
    assert got[(1, 11)].valid and got[(1, 4)].link == "open_call"
    early = got[(1, 1)]
    assert (early.link, early.order_turn, early.order_part) == ("result", 3, 1)
    assert got[(1, 9)].link == "result" and got[(1, 10)].link == "orphan_result" and got[(None, 0)].link == "orphan_result"
    assert got[(1, 0)].link == "none" and got[(1, 0)].valid is None
    for r in got.values():
        parsed = json.loads(r.json)
        assert list(parsed) == sorted(parsed)
    order = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_part, r.turn))
    place = {r.turn: i for i, r in enumerate(order)}
    assert place[1] == place[3] + 1 and place[9] > place[2]
    assert chat_format.format_chats(spark.createDataFrame([], schema), SCHEMAS).count() == 0


CHATS = "conv_id bigint, turn bigint, role string, text string, call_id string, call_name string, arguments string, result_of string"


def test_arguments_of_odd_names(spark):
    schemas = {"t": {"a.b c": {"type": "integer", "required": True}, "it's": {"type": "string"}, 'x"y': {"type": "boolean"}, "$[0]": {"type": "number"}, "": {"type": "array"}}}
    right = ['{"a.b c": 1}', '{"a.b c": 1, "it\'s": "q", "x\\"y": true, "$[0]": 1.5, "": []}']
    wrong = ['{"a": {"b c": 1}}', '{"a.b c": "1"}', '{"a.b c": 1, "it\'s": 2}', '{"a.b c": 1, "x\\"y": 1}', "{}", "[]", "3", "null", "", '{"a.b c": 1', '{"a.b c": null}']
    rows = [(1, i, "assistant", None, f"c{i}", "t", a, None) for i, a in enumerate(right + wrong)]
    out = chat_format.format_chats(spark.createDataFrame(rows, CHATS), schemas).orderBy("turn").collect()
    assert [r.valid for r in out] == [True] * len(right) + [False] * len(wrong)


def test_chains_of_calls(spark):
    at = lambda turn, call, of, conv=1: (conv, turn, "tool", f"m{turn}", call, "t" if call else None, "{}" if call else None, of)
    # 5 calls a; 3 answers a and calls b; 2 answers b and calls c; 9 answers c and calls d; 4 answers d; 7 is plain.
    rows = [at(5, "a", None), at(3, "b", "a"), at(2, "c", "b"), at(9, "d", "c"), at(4, None, "d"), at(7, None, None), at(11, "z", "nothing")]
    rows += [at(1, "x", "y", 2), at(2, "y", "x", 2), at(3, "w", "y", 2), at(0, None, "w", 2)]  # a circle, and what hangs on it
    rows += [at(100 - i, f"n{i}", f"n{i - 1}" if i else None, 3) for i in range(100)]  # a chain told backwards
    df = spark.createDataFrame(rows, CHATS).repartition(5)
    found = chat_format.format_chats(df, {"t": {}})
    assert not python_nodes(found)
    got = {(r.conv_id, r.turn): r for r in found.collect()}
    place = lambda conv: {t: (r.order_turn, r.order_part) for (c, t), r in got.items() if c == conv}
    assert place(1) == {5: (5, 0), 3: (5, 1), 2: (5, 2), 9: (9, 0), 4: (9, 1), 7: (7, 0), 11: (11, 0)}
    assert place(3) == {100 - i: (100, i) for i in range(100)}
    assert got[(1, 3)].link == "result,call" and got[(1, 11)].link == "orphan_result,open_call" and got[(1, 5)].link == "call" and got[(1, 4)].link == "result"
    both = json.loads(got[(1, 3)].json)
    assert both["tool_call_id"] == "a" and both["tool_call"]["id"] == "b"
    assert len(place(2)) == 4 and got[(2, 1)].link == "result,call"


def test_invented_calls_in_sql(spark):
    """Early results, orphans, shared identifiers and bad JSON, against SQL."""
    rnd = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 12)):
            kind, other = rnd.random(), f"c{rnd.randint(0, 6)}"
            call = kind < 0.4
            arguments = rnd.choice(['{"a": 1}', '{"a":1, "note":"abc"}', '{"a": "x"}', "nonsense", '{"note": "y"}', '{"a": 1, "note": "too long"}', None]) if call else None
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), rnd.choice([None, "", "text \"q\"", "é" * 5000]), other if call else None, rnd.choice(["add", "other"]) if call else None, arguments, other if 0.4 <= kind < 0.8 else None))
    df = spark.createDataFrame(rows, CHATS)
    out = chat_format.format_chats(df, SCHEMAS).select("conv_id", "turn", "order_turn", "order_part", "link", "valid")
    sql = """WITH calls AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM m WHERE call_id IS NOT NULL GROUP BY ALL),
    answers AS (SELECT DISTINCT conv_id, result_of FROM m WHERE result_of IS NOT NULL)
    SELECT m.conv_id, m.turn, CASE WHEN m.turn <= call_turn THEN call_turn ELSE m.turn END AS order_turn, CASE WHEN m.turn <= call_turn THEN 1 ELSE 0 END AS order_part,
      CASE WHEN m.call_id IS NOT NULL THEN CASE WHEN a.result_of IS NOT NULL THEN 'call' ELSE 'open_call' END
        WHEN m.result_of IS NOT NULL THEN CASE WHEN call_turn IS NOT NULL THEN 'result' ELSE 'orphan_result' END ELSE 'none' END AS link,
      CASE WHEN m.call_id IS NOT NULL THEN coalesce(call_name = 'add' AND json_valid(arguments) AND json_type(arguments, '$.a') IN ('UBIGINT', 'BIGINT')
        AND (json_type(arguments, '$.note') IS NULL OR length(json_extract_string(arguments, '$.note')) <= 3), FALSE) END AS valid
    FROM m LEFT JOIN calls c ON m.conv_id = c.conv_id AND m.result_of = c.call_id LEFT JOIN answers a ON m.conv_id = a.conv_id AND m.call_id = a.result_of"""
    sql = sql.replace("json_type(arguments,", "json_type(CASE WHEN json_valid(arguments) THEN arguments END,").replace("json_extract_string(arguments,", "json_extract_string(CASE WHEN json_valid(arguments) THEN arguments END,")
    assert here(out) == duck(sql, m=df)


def test_chat_query_in_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q \"x\"\té"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (2, 0, "assistant", "c"), (2, 1, "user", "x" * 400), (2, 2, "user", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert here(chat_format.format_chats(chat_format.as_calls(df), chat_format.ASK)) == duck(chat_format.ORACLE, conversations=df)
