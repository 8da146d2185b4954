"""Cost-balanced packing of tokenised documents into sequences.

A task tokenises its documents and packs them GROUP_TOKENS at a time, so nothing is shuffled and memory is bounded by
a group (or the longest document).  Whole multiples of the sequence length fill sequences of their own.  The rest of
the documents go, longest first, to the sequence of the lowest cost that still has room for them; a sequence's cost
is the sum over its pieces of n + QUADRATIC * n**2 (attention stays within a piece).  There are just as many
sequences as the tokens need, so when a document fits nowhere it is cut at the room of the cheapest open sequence.
All sequences of a group but one are full.

Null and empty texts have the end token only.  Every row is a document of its own, also when ids repeat or are null;
other columns have no part, whatever their names.  Ties in length go by the order of rows in the task, ties in cost to
the first sequence.  An empty table gives no rows.  Sequence ids are unique, but have no meaning.  Words are told apart
by 64-bit hashes.  The file's tokenizer has to lower-case, split by one pattern and drop white space (checked on load);
with others the tokenizer itself is asked, text by text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import chunks, hashed_words

LENGTH = 2048
GROUP_TOKENS = 1 << 22
#: Attention's share for a model of width 4096: 2 * n**2 * width against 12 * n * width**2 of the linear layers.
QUADRATIC = 1 / (6 * 4096)
#: Distinct words, and pieces of words, whose ids a worker keeps; when full it starts again.
MOST_WORDS, MOST_PIECES = 1 << 20, 1 << 18
_PLAIN = "[\\x21-\\x7e\\xa1-\\u012f\\u0131-\\u024f]*"


class WordIds:
    """Ids of texts by a tokenizer file whose tokenizer splits at white space and drops it, word by word.

    Words are told apart by 64-bit hashes.  A word is normalised and split by the tokenizer's own pattern and each
    piece is given to its model; words outside Latin script, or with special tokens, go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            split = self._splitter(json.load(f))
        self.by_word = split is not None
        split = split or ""
        self.model = self.tokenizer.model
        self.split, self.plain = regex.compile(split), regex.compile(_PLAIN)
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.pieces: dict[str, list[int]] = {}
        self._clear()

    def _splitter(self, file: dict) -> str | None:
        """The one pattern by which a file's tokenizer splits, if that is all it does besides lower-casing; else null."""
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = (steps[0].get("pattern") or {}).get("Regex")
        if not split or file.get("model", {}).get("type") != "BPE" or any(x.get("type") not in ("Split", "ByteLevel") for x in steps):
            return None
        # Whether words may go to the tokenizer one by one: white space and case leave no trace.
        probe = ["Word", "it's", "a-b.c", "ÀÉ", "12,5", "x_y", "…"]
        one_by_one = [i for w in probe for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        joined = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (" ".join(probe), "\n\t " + "  \n".join(probe) + " \x0b", " ".join(probe).lower())]
        return split if all(x == one_by_one for x in joined) else None

    def _whole(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text by the tokenizer itself."""
        ids = [self.tokenizer.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return np.array([i for x in ids for i in x], np.int32), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            found = self.pieces[piece] = [t.id for t in self.model.tokenize(spelt)]
        return found

    def _word(self, word: str) -> list[int]:
        if self.plain.fullmatch(word) is None or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        pieces = self.split.findall(word.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return [i for p in pieces for i in self._piece(p)]

    def __call__(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, start of each text's ids and the end of all)."""
        if not self.by_word:
            return self._whole(raw, starts)
        words, first, last, at = hashed_words(raw, starts, lower=False)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        distinct, example, which = np.unique(words, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > MOST_WORDS:
            self._clear()
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == distinct
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            a, z = first[example[new]].tolist(), last[example[new]].tolist()
            ids = [self._word(data[i:j].decode()) for i, j in zip(a, z, strict=True)]
            count = np.array([len(x) for x in ids], np.int64)
            begin = len(self.store) + np.concatenate(([0], np.cumsum(count)[:-1]))
            self.store = np.concatenate([self.store, np.array([i for x in ids for i in x], np.int32)])
            self.hashes = np.insert(self.hashes, place[new], distinct[new])
            self.begin, self.count = np.insert(self.begin, place[new], begin), np.insert(self.count, place[new], count)
            place = np.searchsorted(self.hashes, distinct)
        begin, count = self.begin[place][which], self.count[place][which]
        upto = np.concatenate(([0], np.cumsum(count)))
        ids = self.store[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[at]


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of the pieces of documents of the given lengths; sequences count from 0."""
    pieces: list[tuple[int, int, int, int, int]] = []
    used = 0
    for d in np.flatnonzero(lengths >= size).tolist():
        for start in range(0, int(lengths[d]) - size + 1, size):
            pieces.append((d, start, size, used, 0))
            used += 1
    rest = lengths % size
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    total = int(rest.sum())
    n = -(-total // size)
    room = np.full(n, size, np.int64)
    if n:
        room[-1] = total - (n - 1) * size
    cost, filled = np.zeros(n), np.zeros(n, np.int64)
    for d in order.tolist():
        left, start = int(rest[d]), int(lengths[d] - rest[d])
        while left:
            fits = room >= left
            s = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            take = min(left, int(room[s]))
            pieces.append((d, start, take, used + s, int(filled[s])))
            cost[s] += take + QUADRATIC * take * take
            room[s] -= take
            filled[s] += take
            left, start = left - take, start + take
    return tuple(np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else tuple(np.zeros(0, np.int64) for _ in range(5))


def _packer(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordIds(path))
        spent = TaskContext.get().partitionId() << 32
        doc_ids: list[pa.Array] = []
        groups: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal spent
            ids, lengths = np.concatenate(groups), np.concatenate(counts)
            doc, start, length, sequence, offset = pack(lengths, size)
            base = np.concatenate(([0], np.cumsum(lengths)))
            low = (base[doc] + start) * 4
            data = ids.astype("<u4").tobytes()
            blobs = [data[a:b] for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(doc_ids).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(lengths[doc]), pa.array(sequence + spent), pa.array(offset), pa.array(blobs, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            spent += int(sequence.max()) + 1
            doc_ids.clear(), groups.clear(), counts.clear()

        for batch in batches:
            for a, b, raw, starts in chunks(batch.column(1), 1 << 22):
                ids, at = encoder(raw, starts)
                out = np.insert(ids, at[1:], end_id)
                doc_ids.append(batch.column(0).slice(a, b - a))
                groups.append(out)
                counts.append(np.diff(at) + 1)
                if sum(map(len, groups)) >= GROUP_TOKENS:
                    yield from flush()
        if groups:
            yield from flush()

    return run


_ENCODERS: dict[str, WordIds] = {}


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame, path: str, end_id: int = 1, size: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) per piece; ids: unsigned 32-bit, little-endian.

    path: a tokenizer file that every executor has."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, end_id, size), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
