import math
import random
from collections import Counter

import numpy as np
import zstandard

from millrace.llm.language_id import NgramSpace, fit_languages, identify_languages
from millrace.llm.quality_classifier import fit_quality, score_quality
from millrace.llm.quality_rules import BLANKS, host_verdicts, keep_good, quality_verdicts, text_metrics


def plain_metrics(text):
    text = text or ""
    words, now = [], ""
    for ch in text + " ":
        if ch in BLANKS:
            words += [now] if now else []
            now = ""
        else:
            now += ch
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(ch not in BLANKS for ch in line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(covered))


def test_metrics():
    rnd = random.Random(6)
    for _ in range(200):
        text = "".join(rnd.choice(["a ", "b ", "c\n", "d\t", "é漢 ", "#x ", "\x0b", "a b c d e f g h ", "\n", " ", "line\n"]) for _ in range(rnd.randint(0, 60)))
        assert text_metrics(text) == plain_metrics(text)
    assert text_metrics(None) == (0, 0, 0, 0, 0)


def test_hosts(spark, docs, prose):
    rows = [(i, prose(i), "good") for i in range(30)] + [(100 + i, "short", "bad") for i in range(28)] + [(200, prose(200), "bad"), (300, prose(300), None), (301, None, None), (302, prose(302), "new")]
    out = {r.doc_id: r for r in quality_verdicts(docs(rows)).collect()}
    assert out[0].kept and not out[100].kept and out[100].base_failed
    assert not out[200].base_failed and not out[200].kept and out[200].host_rate > 0.5
    assert out[302].kept and out[300].kept and not out[301].kept
    kept = keep_good(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in out.items() if r.kept)
    assert quality_verdicts(docs([])).count() == 0 and keep_good(docs([])).count() == 0
    assert quality_verdicts(docs([(None, "x", "h"), (1, "x", "h"), (1, "x", "h")])).count() == 3


def plain_hosts(counts):
    """Host -> (rate, kept) from host -> (documents, failures), by the docstring's formulas."""
    total, failed, hosts = sum(n for n, _ in counts.values()), sum(b for _, b in counts.values()), len(counts)
    mean, rho = failed / total, 0.0
    below = total - sum(n * n for n, _ in counts.values()) / total - (hosts - 1)
    if 0 < mean < 1 and below:
        rho = (sum(n * (b / n - mean) ** 2 for n, b in counts.values()) / (mean * (1 - mean)) - (hosts - 1)) / below
    k = 1 / min(max(rho, 1e-6), 0.5) - 1
    out = {}
    for host, (n, b) in counts.items():
        rate = (b + mean * k) / (n + k)
        low = rate - 2 * (rate * (1 - rate) / (n + k + 1)) ** 0.5
        out[host] = (rate, not low * (1 - mean) > 2 * mean * (1 - low))
    return out


def test_host_verdicts_decide_rows(spark):
    # Ten hosts alike, one far worse, one small that only looks worse.
    counts = {f"h{i}": (200, 14 + i) for i in range(10)} | {"worse": (300, 110), "small": (3, 2), None: (50, 3)}
    rows = [(h, i < bad) for h, (n, bad) in counts.items() for i in range(n)]
    got = {r.host: (r.host_rate, r.host_kept) for r in host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    expected = plain_hosts(counts)
    assert all(abs(got[h][0] - rate) < 1e-9 and got[h][1] == kept for h, (rate, kept) in expected.items())
    assert [h for h, (_, kept) in got.items() if not kept] == ["worse"]
    alike = spark.createDataFrame([(f"h{i % 20}", i % 11 == 0) for i in range(4000)], "host string, failed boolean")
    assert host_verdicts(alike).filter("not host_kept").count() == 0
    for only in (True, False):
        assert host_verdicts(spark.createDataFrame([("a", only)] * 30, "host string, failed boolean")).first().host_kept


def test_rules_read_a_very_long_text(spark, docs):
    text = " ".join(f"w{i}" for i in range(300_000))
    out = quality_verdicts(docs([(1, text, "a"), (2, "x " * 200_000, "a")])).orderBy("doc_id").collect()
    assert (out[0].n_words, out[0].n_repeat_words, out[0].kept) == (300_000, 0, True) and out[1].n_repeat_words == 200_000 and out[1].base_failed


def test_quality_classifier(spark, docs, prose):
    bad = lambda i: " ".join(w + "%%% " for w in prose(i, 40).split())
    rows = [(i, prose(i) if i % 3 else bad(i)) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 100_000), (None, "y")]
    df = docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id bigint, quality int")
    model = fit_quality(df, labels, "quality")
    out = {r.doc_id: r for r in score_quality(df, model).collect()}
    right = [out[i].predicted == int(i % 3 > 0) for i in range(200, 300)]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(rows)
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert score_quality(df, fit_quality(df, few, "quality")).filter("score between 0 and 1").count() == len(rows)
    assert score_quality(docs([]), model).count() == 0


def test_quality_scores_by_hand(spark, docs, prose):
    bad = lambda i: " ".join(w + "%%% " for w in prose(i, 40).split())
    rows = [(i, prose(i) if i % 3 else bad(i)) for i in range(240)] + [(900, None), (901, ""), (902, prose(902, 9000))]
    df = docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id bigint, quality int")
    model = fit_quality(df, labels, "quality")
    press = {}
    for name in ("good", "bad"):
        data = zstandard.ZstdCompressionDict(getattr(model, name))
        press[name] = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = {r.doc_id: r for r in score_quality(df, model).collect()}
    for i, text in rows:
        data = (text or "").encode()
        size = {k: sum(len(c.compress(data[a : a + 2048])) for a in range(0, len(data), 2048)) for k, c in press.items()}
        x, y = 0.0, 0.0
        if data:
            x = (size["bad"] - size["good"]) / ((size["bad"] + size["good"]) / 2)
            y = math.log((size["bad"] + size["good"]) / 2 / len(data))
        w = model.weights
        assert abs(out[i].score - 1 / (1 + math.exp(-(w[0] * x + w[1] * y + w[2])))) < 1e-9 and out[i].predicted == int(out[i].score >= 0.3)
    # Repeated rows and labels, in any order, make the same model.
    again = fit_quality(df.unionAll(df).repartition(7), labels.unionAll(labels).repartition(3), "quality")
    assert (again.good, again.bad) == (model.good, model.bad) and np.allclose(again.weights, model.weights)
    # Evidence late in a text counts.
    late = docs([(i, prose(i, 3000) + (" %%% " * 9000 if i % 2 else prose(i + 50, 6000))) for i in range(40)])
    learnt = fit_quality(late, spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id bigint, quality int"), "quality")
    assert all(r.predicted == 1 - r.doc_id % 2 for r in score_quality(late, learnt, threshold=0.5).collect())


def test_language(spark, docs):
    words = {"en": "the and of to in that with from this have", "de": "der die und das ist nicht mit auch für über", "es": "el la que de los para con una está niño"}
    rnd = random.Random(1)
    text = lambda lang: " ".join(rnd.choice(words[lang].split()) for _ in range(25))
    rows = [(i, text(lang), "s", lang) for i, lang in enumerate(["en", "de", "es"] * 40)]
    df = docs(rows)
    model = fit_languages(df.filter("doc_id < 60"), "doc_id", "text", "lang")
    out = {r.doc_id: r for r in identify_languages(df, model).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, _, lang in rows[60:]]) == 1.0
    odd = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs([(1, None), (2, ""), (3, "12 !?"), (4, "the" * 50_000), (None, "und das")]), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] == "en" and odd[None][0] == "de"
    none = fit_languages(df.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in identify_languages(df, none).collect()} == {"und"}
    assert identify_languages(docs([]), model).count() == 0


def test_language_by_hand(spark, docs):
    rnd = random.Random(3)
    alphabets = {"aa": "abcde éü", "bb": "abxyz ñ", "cc": "".join(chr(0x4E00 + 7 * i) for i in range(400))}
    rows = [(i, "".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randint(3, 200))) + "7-_!", "s", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 25)]
    rows += [(100, None, "s", "aa"), (101, "12", "s", "bb"), (102, "xx", "s", None)]

    def letter(point, place):
        return np.roll(np.random.default_rng((10, point)).integers(0, 2, 1024, dtype=np.int8) * 2 - 1, place).astype(float)

    def profile(text):
        words = "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()).split()
        joined = f" {' '.join(words)} " if words else ""
        counts = Counter(joined[i : i + 3] for i in range(len(joined) - 2))
        total = sum((round(64 * math.sqrt(n)) * letter(ord(g[0]), 0) * letter(ord(g[1]), 1) * letter(ord(g[2]), 2) for g, n in counts.items()), np.zeros(1024))
        return total / max(np.linalg.norm(total), 1e-9)

    df = docs(rows)
    model = fit_languages(df.filter("doc_id < 60"), "doc_id", "text", "lang")
    prototypes = {lang: sum(profile(t) for i, t, _, own in rows if i < 60 and own == lang) for lang in alphabets}
    prototypes = {lang: v / np.linalg.norm(v) for lang, v in prototypes.items()}
    for r in identify_languages(df, model).collect():
        cosines = {lang: float(profile(rows[[x[0] for x in rows].index(r.doc_id)][1]) @ v) for lang, v in prototypes.items()}
        if any(cosines.values()):
            assert r.lang_pred == max(sorted(cosines), key=cosines.get) and abs(r.score - max(max(cosines.values()), 0)) < 1e-4
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    again = fit_languages(df.filter("doc_id < 60").repartition(5), "doc_id", "text", "lang")
    assert (again.prototypes == model.prototypes).all()
    # Alike prototypes tie: the first by name is taken.
    same = fit_languages(docs([(1, "hello there", "s", "zz"), (2, "hello there", "s", "bb"), (2, "hello there", "s", "bb")]), "doc_id", "text", "lang")
    assert identify_languages(docs([(5, "hello")]), same).first().lang_pred == "bb"
    space = NgramSpace()
    assert len({space.letter(0x4E00 + i).tobytes() for i in range(2000)}) == 2000
