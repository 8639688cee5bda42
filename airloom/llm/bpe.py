"""Byte-pair encoding and decoding with the library's own merge loop.

Merges come off a priority queue of (rank, position) over a doubly linked list of symbols; an entry
whose symbols have changed since it was pushed is stale and skipped. Decoding joins the vocabulary
strings of the ids. Texts stay in their rows: the job has no shuffle.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from airloom.llm.common import encoded, sliced

MEMO_WORDS = 200_000  # words remembered, twice over; bounds a worker's memory, never the result
# Fixed values of the tokenizer file's format: its white space and its pre-token pattern.
SPACE = r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next free code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file (BPE with word ends, NFC and lower case, byte letters)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.words = {i: w for w, i in [*self.vocab.items(), *self.special.items()]}
        self.end = model["end_of_word_suffix"] or ""
        ids = self.vocab
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.end] for c in letters]
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.blank = regex.compile(SPACE).sub
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        # Ids and decoded text of each chunk: the words met lately, and those met before them.
        self.young: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}
        self.merged: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if hit := ranks.get((ids[i], ids[i + 1])):
                queue.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (hit[0], i, new, ids[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := ranks.get((ids[h], new))):
                heapq.heappush(queue, (hit[0], h, ids[h], new, hit[1]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """Normal form, cut into pre-tokens. Lower case is by single characters: sigma has no final form."""
        plain = self.blank(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return self.split(plain)

    def _chunk(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids of a blank-free chunk as packed 32-bit integers, and the text they decode to."""
        ids: list[int] = []
        for part in self.cut(raw.decode()):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.pieces(part):
                if (known := self.merged.get(piece)) is None:
                    known = self.merged[piece] = tuple(self.merge(piece))
                ids += known
        return array("i", ids).tobytes(), self.decode(ids).encode()

    def chunks(self, text: bytes) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of a text's chunks; blanks are boundaries, so chunks are remembered by themselves.

        When the younger memory is full it becomes the older one: what was met in neither half is forgotten, frequent
        words stay.
        """
        words = (text if b"<|" in text else text.lower()).split()
        young, old = self.young, self.old
        for w in set(words).difference(young):
            young[w] = old.get(w) or self._chunk(w)
        found = list(map(young.__getitem__, words))
        if len(young) > MEMO_WORDS:
            self.old, self.young = young, {}
            self.merged.clear()
        return found

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a whole text."""
        return b"".join([ids for ids, _ in self.chunks(text)])

    def round_trip(self, text: bytes) -> tuple[bytes, bytes]:
        """Packed ids of a whole text and the text they decode to; chunks without ids leave no blank."""
        found = self.chunks(text)
        return b"".join([ids for ids, _ in found]), b" ".join([part for _, part in found if part])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a blank, as the library does without a decoder; special tokens stay."""
        return " ".join(map(self.words.__getitem__, ids))


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One per worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    offsets, at = [0], 0
    for p in packed:
        at += len(p) // 4
        offsets.append(at)
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>): the token ids of each whole text.

    Null and empty texts give an empty list; repeated rows stay repeated; null keys stay null; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in sliced(batches, 1):
            packed = [bpe.encode(t) for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists(packed)], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, ids, decoded): the vocabulary strings of the ids, joined. A null list decodes to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [bpe.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [key, ids, "decoded"])

    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {dict(tokens.dtypes)[key]}, `{ids}` array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, decoded) in one pass over the texts: `decode` of `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in sliced(batches, 1, 1 << 20):
            made = [bpe.round_trip(t) for t in encoded(batch.column(1))]
            texts = pa.array([text for _, text in made], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), _id_lists([ids for ids, _ in made]), texts], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>, decoded string")
