"""Alignment of the tokens of two tokenizers over the same bytes.

All documents of a batch are merged in lockstep: state vectors hold one pointer into A and one into B per lane, each
step compares the ends under all pointers at once, emits the links (and with them the cuts between groups), advances
the pointer behind and drops finished lanes. A lane is a document, or a byte range of LANE tokens of a longer one:
ends are sorted, so ranges merge apart.

Links are counted over the corpus by partial sums per task. Frequent pairs, at most HOT_PAIRS of them by a histogram
of counts, are broadcast to price each document's links; the rest, all rarer than those, go through a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.bpe import byte_letters
from airloom.llm.common import discard, encoded, reread, sliced

LANE = 512  # tokens of A in a lane
SLICE = 1 << 20  # bytes of text aligned at a time, at least one text
LONG = 24  # letters of a chunk that is still worth remembering
MEMO = 64 << 20  # bytes of chunks a worker remembers, twice over; never a bound on the result
ENTRY = 250  # bytes a remembered chunk takes besides its letters and ids
TALLY = 1 << 19  # pairs a task sums before it lets them go
HOT_PAIRS = 1 << 20  # bound of the broadcast: 17 bytes each
SHIFT = 32
SPACE = "▁"


class Pair:
    """Both encoders, with a memory of chunks: white space and the word after it.

    A cut between a word and white space is a token boundary for A, whose pattern lets no token run from one into the
    other. It is one for B unless the white space is a character that B has in pieces of several (a carriage return):
    there the chunk goes on. Were there pieces with a space after another character, texts would be encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of.get(c, 0) for c in token)
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.tokens = [pa.array(table, pa.large_binary()) for table in (self.bytes_a, self.bytes_b)]
        self.sizes = [np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b)]
        words = [p for i, p in enumerate(self.pieces) if len(p) > 1 and not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        glue = "".join(sorted({re.escape(c) for p in words for c in p if c.isspace()}))
        self.cut = re.compile(rf"\s*+\S++(?:[{glue}]\s*+\S*+)*+|\s+" if glue else r"\s*+\S++|\s+").findall
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in words):
            self.cut = lambda text: [text]
        self.blank = self.b.piece_to_id(SPACE)
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        self.odd: set[str] = set()
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.decimals = pa.array([f"{i}{end}".encode() for i in ids for end in (",", "|", ";", "")], pa.large_binary())

    def _pieces(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks, without the space that B puts in front unless the chunk begins with one."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [([self.blank] if c == " " else ids) if c[0] == " " else ids[1:] for c, ids in zip(chunks, found)]

    def _gives_back(self, k: int, ids: np.ndarray, cuts: np.ndarray, chunks: list[str]) -> list[bool]:
        """Whether the bytes of each chunk's ids are the chunk."""
        joined = self.tokens[k].take(pa.array(ids))
        _, offsets, data = joined.buffers()
        raw, at = data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int64)[cuts]
        wanted = [c.encode() for c in chunks]
        if np.array_equal(np.diff(at), [len(w) for w in wanted]) and raw[: at[-1]] == b"".join(wanted):
            return [True] * len(chunks)
        return [raw[i:j] == w for w, i, j in zip(wanted, at, at[1:])]

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Packed ids of A and B of all these chunks."""
        out, missing = {}, []
        for c in chunks:
            if (known := self.young.get(c)) is None:
                if (known := self.old.get(c)) is None:
                    missing.append(c)
                    continue
                self._keep(c, known)
            out[c] = known
        if missing:
            found = [[e.ids for e in self.a.encode_batch_fast(missing, add_special_tokens=False)], self._pieces(missing)]
            packed, right = [], []
            for k, lists in enumerate(found):
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                ids = np.fromiter(chain.from_iterable(lists), np.int32, int(cuts[-1]))
                right.append(self._gives_back(k, ids, cuts, missing))
                raw, at = ids.tobytes(), (4 * cuts).tolist()
                packed.append([raw[i:j] for i, j in zip(at, at[1:])])
            self.odd.update(c for c, a, b in zip(missing, *right) if not (a and b))
            for c, *known in zip(missing, *packed):
                out[c] = known = tuple(known)
                if len(c) <= LONG:
                    self._keep(c, known)
        return out

    def _keep(self, chunk: str, known: tuple[bytes, bytes]) -> None:
        self.young[chunk] = known
        self.held += ENTRY + len(chunk) + len(known[0]) + len(known[1])

    def forget(self) -> None:
        """Let the older half go once the younger is full: frequent chunks stay."""
        if self.held > MEMO:
            self.old, self.young, self.held = self.young, {}, 0
            self.odd.intersection_update(self.old)

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Packed ids of A and B of each text; none where there is no text or one of them does not give it back."""
        cut = [self.cut(" " + t.decode()) if t else [] for t in texts]
        known = self.learn(set().union(*cut))
        out = []
        for text, chunks in zip(texts, cut):
            a, b = (b"".join(x) for x in zip(*map(known.__getitem__, chunks))) if chunks else (b"", b"")
            if self.odd and not self.odd.isdisjoint(chunks):
                joined = [b"".join(map(t.__getitem__, np.frombuffer(x, np.int32))) for t, x in ((self.bytes_a, a), (self.bytes_b, b))]
                if joined != [b" " + text] * 2:
                    a = b = b""
            out.append((a, b))
        self.forget()
        return out


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(path_a: str, path_b: str) -> Pair:
    """One per worker process, kept between tasks."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of the tokens that end together, for lanes [a, a_stop) and [b, b_stop) of sorted ends."""
    live = (a < a_stop) & (b < b_stop)
    a, a_stop, b, b_stop = (v[live] for v in (a, a_stop, b, b_stop))
    links_a, links_b = [a[:0]], [b[:0]]
    while len(a):
        x, y = ends_a[a], ends_b[b]
        same = x == y
        links_a.append(a[same])
        links_b.append(b[same])
        a = a + (x <= y)
        b = b + (y <= x)
        live = (a < a_stop) & (b < b_stop)
        if not live.all():
            a, a_stop, b, b_stop = (v[live] for v in (a, a_stop, b, b_stop))
    at_a, at_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(at_a)
    return at_a[order], at_b[order]


class Aligned:
    """The links of a few documents: ids of A and B end to end, documents' bounds in them, linked positions."""

    def __init__(self, pair: Pair, texts: list[bytes]):
        self.pair = pair
        packed = pair.encode(texts)
        self.a, self.b = (np.frombuffer(b"".join([p[k] for p in packed]), np.int32) for k in (0, 1))
        self.bounds_a, self.bounds_b = (np.concatenate([[0], np.cumsum([len(p[k]) // 4 for p in packed])]).astype(np.int64) for k in (0, 1))
        # Ends count on through the documents, which both sides fill with the same bytes.
        ends_a, ends_b = (np.cumsum(pair.sizes[k][x]) for k, x in ((0, self.a), (1, self.b)))
        starts = [np.arange(i, j, LANE) for i, j in zip(self.bounds_a, self.bounds_a[1:])]
        start = np.concatenate([*starts, self.bounds_a[-1:]]).astype(np.int64)
        before = np.concatenate([[0], ends_a])[start]
        start_b = np.searchsorted(ends_b, before, "right")
        self.link_a, self.link_b = lockstep(ends_a, ends_b, start[:-1], start[1:], start_b[:-1], start_b[1:])
        # Each document ends in a link, so links up to its last token are those of it and the documents before.
        self.bounds = np.searchsorted(self.link_a, self.bounds_a, "left")

    def pairs(self) -> np.ndarray:
        return self.a[self.link_a].astype(np.int64) << SHIFT | self.b[self.link_b]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        groups = len(self.link_a)
        group_a, group_b = (np.repeat(np.arange(groups), np.diff(link, prepend=-1)) for link in (self.link_a, self.link_b))
        ends = [np.zeros(len(x), np.int64) for x in (self.a, self.b)]
        ends[0][self.link_a], ends[1][self.link_b] = 1, 2
        last = self.bounds_b[1:][np.diff(self.bounds_b) > 0] - 1
        ends[1][last] = 3
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.concatenate([[0], self.link_b + 1])[group_a]] = self.a.astype(np.int64) * 4 + ends[0]
        order[np.arange(len(self.b)) + self.link_a[group_b] + 1] = self.b.astype(np.int64) * 4 + ends[1]
        joined = self.pair.decimals.take(pa.array(order))
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[self.bounds_a + self.bounds_b]
        view = memoryview(data) if data is not None else memoryview(b"")
        return [hashlib.sha256(view[i:j]).hexdigest() if i < j else "" for i, j in zip(at, at[1:])]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, a_ids, b_ids, a_cuts, b_cuts): both tokenizations of space + text and the groups they share.

    Group g holds the tokens of A from a_cuts[g-1] (0 before the first) to a_cuts[g], likewise of B. Texts null,
    empty or not given back by both tokenizers have empty lists; repeated rows stay, null keys stay null, an empty
    table gives no rows, other columns are ignored, whatever their names. A task holds about SLICE bytes of text, or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(path_a, path_b)
        for batch in sliced(batches, 1, SLICE):
            x = Aligned(pair, encoded(batch.column(1)))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(x.bounds))
            columns = [
                _lists(x.a, x.bounds_a, pa.int32()),
                _lists(x.b, x.bounds_b, pa.int32()),
                _lists(x.link_a + 1 - x.bounds_a[doc], x.bounds, pa.int32()),
                _lists(x.link_b + 1 - x.bounds_b[doc], x.bounds, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "a_ids", "b_ids", "a_cuts", "b_cuts"])

    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_cuts", "b_cuts"))
    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {lists}")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)


COUNTED = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>, tally boolean"


def _counted(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """Per document its figures, digest, distinct linked pairs and their numbers; per task rows of summed pairs (tally)."""
    names = [key, *[c.split()[0] for c in COUNTED.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, parts, held = loaded(path_a, path_b), [], 0

        def tally():
            pairs, n = parts[0]
            cuts = np.append(np.arange(0, len(pairs), 1 << 15), len(pairs))
            rows = len(cuts) - 1
            nulls = [pa.nulls(rows, t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.string())]
            return pa.RecordBatch.from_arrays([*nulls, _lists(pairs, cuts, pa.int64()), _lists(n, cuts, pa.int64()), pa.array([True] * rows)], names)

        kind = pa.int64()
        for batch in sliced(batches, 1, SLICE):
            kind = batch.column(0).type
            x = Aligned(pair, encoded(batch.column(1)))
            distinct, at, n = np.unique(x.pairs(), return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(x.bounds))
            cells, counts = np.unique(doc * max(len(distinct), 1) + at, return_counts=True)
            owner, which = np.divmod(cells, max(len(distinct), 1))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            figures = [np.diff(b) for b in (x.bounds_a, x.bounds_b, x.bounds)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(f, pa.int64()) for f in figures],
                    pa.array(x.digests(), pa.string()),
                    _lists(distinct[which], cuts, pa.int64()),
                    _lists(counts, cuts, pa.int64()),
                    pa.array([False] * batch.num_rows),
                ],
                names,
            )
            parts.append((distinct, n))
            held += len(distinct)
            if held > TALLY:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > TALLY // 2:
                    yield tally()
                    parts, held = [], 0
        if held:
            parts = [_summed(parts)]
            yield tally()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {COUNTED}")


def _pair_table(counted: DataFrame) -> DataFrame:
    """Rows (pair, n, best): links of each pair in the corpus and whether its B id has none more frequent."""
    each = counted.filter("tally").select(F.explode(F.arrays_zip("pairs", "counts")).alias("c")).select("c.*")
    pairs = reread(counted.sparkSession, each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    top = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    return pairs.withColumn("b", b_id).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _hot_level(pairs: DataFrame, bound: int) -> int:
    """Least power of two such that at most `bound` pairs have so many links; at most 64 rows reach the driver."""
    level = F.floor(F.log2("n")).cast("int")
    levels = dict(pairs.groupBy(level.alias("level")).count().collect())
    total, lowest = 0, 64
    for i in sorted(levels, reverse=True):
        total += levels[i]
        if total > bound:
            break
        lowest = i
    return lowest


def link_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    An id pair counts its links in the whole corpus; count_sum adds those counts over a document's links, n_best counts
    the links no other pair of whose B id counts more. Cases as in `align`: documents without tokens have zeros and ''.
    """
    spark = docs.sparkSession
    counted = reread(spark, _counted(docs, path_a, path_b, key, text).withColumn("row", F.monotonically_increasing_id()), "links")
    pairs = reread(spark, _pair_table(counted), "pairs")
    level = _hot_level(pairs, hot_pairs)
    hot = pairs.filter(F.col("n") >= F.lit(2.0**level)).orderBy("pair").toArrow()
    names = (key, "n_a", "n_b", "n_groups", "groups_sha256", "row")
    table = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                pairs, counts = (part.column(k).flatten().to_numpy() for k in (6, 7))
                doc = np.repeat(np.arange(part.num_rows), np.diff(part.column(6).offsets.to_numpy()))
                at = np.searchsorted(known, pairs)
                found = np.zeros(len(pairs), bool)
                inside = at < len(known)
                found[inside] = known[at[inside]] == pairs[inside]
                price, top = (np.zeros(len(pairs), np.int64) for _ in range(2))
                price[found], top[found] = n[at[found]] * counts[found], best[at[found]] * counts[found]
                sums = [np.zeros(part.num_rows, np.int64) for _ in range(2)]
                for total, values in zip(sums, (top, price)):
                    np.add.at(total, doc, values)
                cold = ~found
                cuts = np.searchsorted(doc[cold], np.arange(part.num_rows + 1))
                rest = [_lists(pairs[cold], cuts, pa.int64()), _lists(counts[cold], cuts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], *[pa.array(s) for s in sums], *rest], [*names, "n_best", "count_sum", "pairs", "counts"])

    kinds = dict(counted.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    rows = counted.filter("not tally").select(*names, "pairs", "counts")
    priced = rows.mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<long>, counts array<long>")
    priced = reread(spark, priced, "priced")
    table.destroy()
    discard(counted)
    cold = priced.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("c")).select("row", F.col("c.pairs").alias("pair"), F.col("c.counts").alias("times"))
    rare = pairs.filter(F.col("n") < F.lit(2.0**level))
    # Every pair of `cold` has fewer than 2^level links, so no key of this join is hot.
    extra = cold.join(rare, "pair").groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    out = priced.join(extra, F.col("row") == F.col("_row"), "left")
    return out.select(
        key,
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
