"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rotated) by its place. A text's
profile bundles (sums) the vectors of its n-grams, a language's prototype those of all its
texts, and a text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A code point needs 21 bits, so three of them fit a 64-bit number.
DIMENSIONS, N, BITS = 1024, 3, 21
#: Letters whose vectors a Python worker remembers (4 KB each).
LETTER_MEMORY = 8192
WEIGHT = 64
#: Profiles of length 1 are added up as whole numbers of this fraction, so that sums don't depend on their order.
UNIT = 1 << 20
#: Rows into which a language's partial sums are dealt before they are added up.
FAN = 64
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def symbols(text: str) -> np.ndarray:
    """A text's letters as lower-case code points, with 32 around and between words."""
    letters = _OTHER.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, dtype=np.int64)
    return np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)


class NgramSpace:
    """Vectors of letters and n-grams, made from a seed; alike on every machine."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 10):
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        """A letter's vector, rotated for each place of an n-gram."""
        found = self._letters.get(point)
        if found is None:
            if len(self._letters) >= LETTER_MEMORY:
                self._letters.clear()
            signs = np.random.default_rng((self.seed, point)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            found = self._letters[point] = np.stack([np.roll(signs, place) for place in range(N)])
        return found

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dimensions), dtype=np.int8)
        for place in range(N):
            points, index = np.unique(grams >> BITS * place & (1 << BITS) - 1, return_inverse=True)
            out *= np.stack([self.letter(p)[place] for p in points.tolist()])[index]
        return out

    @staticmethod
    def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's n-grams, and how often each occurs."""
        codes = symbols(text or "")
        n = len(codes) - N + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.unique(sum(codes[k : k + n] << BITS * k for k in range(N)), return_counts=True)

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """A row of length 1 for each text, zero without letters.

        An n-gram found n times weighs ``round(WEIGHT * sqrt(n))``: sums of whole numbers are exact
        in any order, so a text's profile doesn't depend on the texts beside it.
        """
        found = [self.grams(t) for t in texts]
        every = np.unique(np.concatenate([g for g, _ in found])) if found else np.zeros(0, dtype=np.int64)
        out = np.zeros((len(texts), self.dimensions))
        for at in range(0, len(every), 4096):  # bounds memory whatever the alphabet
            part = every[at : at + 4096]
            counts = np.zeros((len(texts), len(part)), dtype=np.float32)
            for row, (grams, n) in enumerate(found):
                a, b = np.searchsorted(grams, [part[0], part[-1] + 1])
                counts[row, np.searchsorted(part, grams[a:b])] = np.rint(WEIGHT * np.sqrt(n[a:b]))
            out += counts @ self.vectors(part).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


class LanguageModel:
    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes

    def predict(self, texts: list[str | None], space: NgramSpace) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        profiles = space.profiles(texts)
        cosines = profiles @ self.prototypes.T
        best = cosines.argmax(axis=1)
        known = np.array([len(_OTHER.sub("", t or "")) > 0 for t in texts], dtype=bool)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0)

    def column(self, text: Column) -> Column:
        """A struct of the predicted language and its cosine."""
        model = self

        @F.arrow_udf("struct<lang_pred:string,score:double>")
        def run(texts: pa.Array) -> pa.Array:
            space, names, scores = _space(), [], []
            for at in range(0, len(texts), 64):
                own, cosines = model.predict(texts.slice(at, 64).to_pylist(), space)
                names += own
                scores.append(cosines.astype(float))
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["lang_pred", "score"])

        return run(text)


_SPACES: list[NgramSpace] = []


def _space() -> NgramSpace:
    if not _SPACES:
        _SPACES.append(NgramSpace())
    return _SPACES[0]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, part, total)``: a task's sum of profiles for each language, in UNITs."""
    space, totals = _space(), {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            own = batch.slice(at, 64)
            profiles = np.rint(space.profiles(own.column(1).to_pylist()) * UNIT).astype(np.int64)
            for lang, row in zip(own.column(0).to_pylist(), profiles):
                if lang not in totals:
                    totals[lang] = np.zeros(DIMENSIONS, dtype=np.int64)
                totals[lang] += row
    names = sorted(totals)
    parts = pa.array([hash(totals[n].tobytes()) % FAN for n in names], pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), parts, pa.array([totals[n].tobytes() for n in names], pa.binary())], ["lang", "part", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one ``(lang, part)`` as one."""
    total, lang, part = np.zeros(DIMENSIONS, dtype=np.int64), None, 0
    for batch in batches:
        for row in batch.to_pylist():
            lang, part = row["lang"], row["part"]
            total += np.frombuffer(row["total"], dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "part", "total"])


def fit_languages(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> LanguageModel:
    """Prototypes from all rows with a language and a text.

    Profiles are added up on the executors, each task's sum for a language in one row; at most
    FAN rows of each language, 8 KB each, come to the driver, whatever the size of the table
    (the number of languages is that of the labels in use). Whole texts count, each with the
    same weight; repeated rows count as often as they occur; ids are not used. Sums are of whole
    numbers, so the model doesn't depend on how rows are dealt.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    kind = "lang string, part int, total binary"
    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(_sums, kind).groupBy("lang", "part").applyInArrow(_added, kind).collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["total"], dtype=np.int64)
    languages = sorted(sums)
    totals = np.array([sums[lang] for lang in languages], dtype=np.float64).reshape(len(languages), DIMENSIONS)
    return LanguageModel(languages, (totals / np.maximum(np.linalg.norm(totals, axis=1), 1e-9)[:, None]))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, lang_pred, score)`` for each row of ``docs``; no shuffle.

    ``und`` with score 0 if the text is null, empty or has no letter, or if the model
    has no language. Of languages with the same cosine the first by name is taken. Texts of any
    length are read whole, a part of their n-grams at a time. Null ids and repeated rows each
    get a row; other columns are not read. An empty table gives an empty one.
    """
    return docs.select(id_col, model.column(F.col(text_col)).alias("__l")).select(id_col, "__l.lang_pred", "__l.score")
