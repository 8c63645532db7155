"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can stand last
in the prefix's BPE encoding. A table of these last tokens is filled from left to
right: a token that ends at position ``i`` and begins at ``j`` is the last one iff
it stays apart from the last token of prefix ``j``. Walking back through the table
gives the encoding of any prefix, so a text can be appended to without encoding it
anew, and after an edit the table is refilled only until it agrees with the old one.
"""

from __future__ import annotations

import base64
import gc
import threading
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces whose encoding a Python worker remembers, about 250 bytes each. When half of them are
#: new, those that were not met since the last time are forgotten.
PIECE_MEMORY = 800_000
#: Pairs of neighbours that it remembers.
PAIR_MEMORY = 250_000
#: How long an idle Python worker remembers them.
IDLE_SECONDS = 3.0


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens with their ranks, and which neighbours BPE leaves apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every end of a token, with its rank if it is a token itself, else -1.
        self.endings = dict.fromkeys((token[i:] for token in ranks for i in range(1, len(token))), -1) | ranks
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token in self._halves:
            return self._halves[token]
        text = self.token_bytes[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            found = [(self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)]
            rank, at = min(found)
            if rank >= token:
                raise ValueError(f"token {token} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        self._halves[token] = out
        return out

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they are neighbours."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > PAIR_MEMORY:
                self._apart.clear()
            known = self._apart[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        # Undo the merges at the border, latest first; a merge across the border
        # must not come before the merge undone last.
        before = 1 << 60
        while True:
            across = self.ranks.get(self.token_bytes[left] + self.token_bytes[right])
            if across is not None and across < before:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left and (left > right or not of_right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                return True


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _extend(self, end: int) -> Iterator[int]:
        """Fill the entries up to ``end``, one by one."""
        v, data, last = self.vocabulary, self.data, self.last
        ending, apart, known, longest = v.endings.get, v.apart, v._apart.get, v.longest
        for stop in range(len(last) + 1, end + 1):
            fits = []
            start, least = stop - 1, max(-1, stop - 1 - longest)
            while start > least:
                rank = ending(data[start:stop])
                if rank is None:
                    break
                if rank >= 0:
                    fits.append((start, rank))
                start -= 1
            for start, rank in reversed(fits):
                if start == 0:
                    break
                before = last[start - 1]
                stays = known(before << 32 | rank)
                if stays or (stays is None and apart(before, rank)):
                    break
            else:
                raise ValueError(f"no token for byte {data[stop - 1]}")
            last.append(rank)
            yield rank

    def append(self, more: bytes) -> None:
        self.data += more
        for _ in self._extend(len(self.data)):
            pass

    def truncate(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length:]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start:stop``; returns how many entries were computed.

        Entries depend on those up to the longest token's length before them, so
        once as many in a row agree with the old table, so does the rest.
        """
        tail, old = self.data[stop:], self.last[stop:]
        self.truncate(start)
        self.append(new)
        done, agreed = len(new), 0
        self.data += tail
        for i, token in enumerate(self._extend(len(self.data))):
            done += 1
            reaches_into_tail = len(self.vocabulary.token_bytes[token]) <= i + 1
            agreed = agreed + 1 if token == old[i] and reaches_into_tail else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[i + 1 :]
                break
        return done

    def tokens(self, length: int | None = None) -> list[int]:
        """The encoding of the prefix of ``length`` bytes, of all by default."""
        end = len(self.data) if length is None else length
        out = []
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.token_bytes[token])
        return out[::-1]


class Encoder:
    """Encodes texts: each match of ``pattern`` separately, by a prefix table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode new pieces in order, so that neighbours share what their common prefix filled."""
        known, ranks = self._known, self.vocabulary.ranks
        shared = PrefixTable(self.vocabulary)
        for data, piece in sorted((p.encode("utf-8", "replace"), p) for p in pieces):
            whole = ranks.get(data)
            if whole is not None:
                known[piece] = (whole,)
                continue
            same, most = 0, min(len(data), len(shared.data))
            while same < most and data[same] == shared.data[same]:
                same += 1
            shared.truncate(same)
            shared.append(data[same:])
            known[piece] = tuple(shared.tokens())

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.split(text))

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        known = self._known
        found = list(map(known.get, pieces))
        if None in found:
            new = [i for i, ids in enumerate(found) if ids is None]
            if len(known) + len(new) > PIECE_MEMORY // 2:
                self._older, self._known = known, {}
                known = self._known
            older = self._older
            unmet = set()
            for i in new:
                ids = older.get(pieces[i])
                if ids is None:
                    unmet.add(pieces[i])
                else:
                    found[i] = known[pieces[i]] = ids
            self._learn(unmet)
            for i in new:
                if found[i] is None:
                    found[i] = known[pieces[i]]
        return list(chain.from_iterable(found))

    def forget(self) -> None:
        self._known, self._older = {}, {}
        self.vocabulary._apart.clear()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def shared_encoder(ranks_path: str, pattern: str) -> Encoder:
    """This process's encoder: a Python worker keeps it, and the pieces it knows, from task to task."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(ranks_path), pattern)
    return _ENCODERS[key]


class _Use:
    """Counts this process's encoding tasks; its encoders forget their pieces once it has none for IDLE_SECONDS.

    A Python worker outlives its stage, and what it remembers would be taken from the next one.
    """

    def __init__(self):
        self.lock, self.tasks, self.ended = threading.Lock(), 0, 0

    def __enter__(self) -> None:
        with self.lock:
            self.tasks += 1

    def __exit__(self, *_) -> None:
        with self.lock:
            self.tasks -= 1
            self.ended += 1
            timer = threading.Timer(IDLE_SECONDS, self.forget, (self.ended,))
        timer.daemon = True
        timer.start()

    def forget(self, ended: int) -> None:
        with self.lock:
            if self.tasks == 0 and self.ended == ended:
                for encoder in _ENCODERS.values():
                    encoder.forget()


_USES: list[_Use] = []


def _in_use() -> _Use:
    if not _USES:
        _USES.append(_Use())
    return _USES[0]


class TextTable:
    """A text that grows at its end, with its encoding at hand.

    Only the last match of the pattern can change when text is appended.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self._done: list[int] = []
        self._open = ""
        self.append(text)

    def append(self, more: str) -> None:
        pieces = self.encoder.split(self._open + more)
        if pieces:
            self._done += self.encoder.encode_pieces(pieces[:-1])
            self._open = pieces[-1]

    def tokens(self) -> list[int]:
        return self._done + (self.encoder.encode(self._open) if self._open else [])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, ids array<int>, decoded binary)`` for each row of ``docs``.

    ``ids`` are the token ids of the whole text, ``decoded`` the bytes of these ids.
    ``ranks_path`` names a file that every executor has (it is part of an installed
    package). A null or empty text gives no ids and no bytes; a null id stays null;
    repeated rows give repeated rows; an empty table gives an empty one. Other columns
    are not carried, so their names can't clash. No shuffle; memory is one Arrow batch
    and a bounded memory of pieces. A text of any length is encoded whole. A vocabulary that
    lacks a byte of a text, or has a token that merges of its other tokens can't reach, raises
    ValueError: no byte-level BPE training gives one.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                all_ids, decoded = [], []
                for text in part.column(1).to_pylist():
                    ids = encoder.encode(text) if text else []
                    all_ids.append(np.array(ids, dtype=np.int32))
                    decoded.append(encoder.decode(ids))
                offsets = np.zeros(len(all_ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in all_ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Encoding makes no cycles, and looking for them among all remembered pieces takes an eighth of its time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            with _in_use():
                yield from encoded(batches)
        finally:
            if collecting:
                gc.enable()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
