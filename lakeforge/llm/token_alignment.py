"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

A text (with a space before it) is cut into *groups* at the byte offsets where tokens of both tokenizers end.  A
*fragment* is what a byte range tells of that: the tokens before its first common end (open head), the groups between
its first and its last one (closed), the tokens after it (open tail).  Fragments of neighbouring ranges compose: tail
and head between them are one group, all else is added up; that is associative, so the ranges of a document may be
folded in any tree.

* Documents of at most ``CHUNK`` characters are folded where they are read.
* Longer ones are dealt out as chunks over all tasks.  A chunk ends anywhere; it carries the text from the last *proven*
  boundary before it to the first one after it, and keeps the tokens that end inside it.  Both tokenizers begin anew at
  a proven boundary (a space between two characters that are not white space): no merge of either crosses one.  Where no such
  boundary is near, the chunk is made longer up to the next.  Chunks are then folded ``FAN`` at a time, round by round,
  each round written to the shared folder.

Within a range the pieces between proven boundaries repeat; the first tokenizer's ids of a piece are remembered.

*Counts.*  A link is a pair of token occurrences whose byte ranges overlap.  Each batch of documents has a dictionary of
its distinct id pairs, documents name pairs by their place in it.  Dictionaries are added up into the corpus-wide
counts (map-side first), the counts are joined to the dictionaries, and each batch is put together with its own
dictionary again; so neither texts nor a row per token are shuffled, nothing is broadcast but the two vocabularies
(some 2 MB), and a task holds one batch at a time.

Defined results: a null or empty text, and one whose tokens' joined bytes are not the text's (a U+2581 in it, say), has
no tokens: zeros and an empty digest column.  The strings of special tokens are plain text.  Repeated rows each get a
row and count as often as they are there; ids are not looked at; extra columns are ignored; an empty table gives an
empty result.  A document's groups, written out, are some three times its size and must fit a row (2 GB).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, map_batches, text_values
from .pieces import BOUNDARY, Memo, split

#: Characters of a chunk of a long document; fragments folded at a time.
CHUNK, FAN = 65_536, 16
#: Below this character (Latin letters, common signs) all editions of Unicode agree on what is a letter, digit or space, so
#: the same vocabulary, split pattern and merges give the same tokens in either library.
SETTLED = "\u0250"


def byte_of_symbol() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table.update((chr(0x100 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(plain)))
    return table


class Pair:
    """The two tokenizers: ids of texts, and the bytes and decimal digits of an id."""

    def __init__(self, vocabulary_a: bytes, vocabulary_b: bytes, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(vocabulary_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabulary_b)
        symbols = byte_of_symbol()
        named = {i: bytes(symbols[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [named.get(i, b"") for i in range(max(named) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # how an id is written: one of A before another of A and before those of B, one of B before another and before the next group
        self.writing = [b"%d%s" % (i, after) for n, after in ((len(self.a_bytes), b","), (len(self.a_bytes), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";"))
                        for i in range(n)]
        self.quick = None
        if pattern:
            import tiktoken

            ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
            self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(lambda pieces: [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)])

    def ids(self, stretch: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a stretch that begins with a space; None where their bytes are not the stretch's."""
        if self.quick is not None and max(stretch) < SETTLED:
            a = self.quick.encode_ordinary(stretch)
        else:
            a = list(chain.from_iterable(self.memo.of(split(stretch[1:], " "))))
        b = self.b.encode(stretch[1:], num_threads=1)
        raw = stretch.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def closed(self, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes, np.ndarray]:
        """(groups, groups written out, links as packed id pairs) of two runs that begin and end together.

        Every link is one stretch between neighbouring ends, whichever tokenizer they belong to.
        """
        if not len(a):
            return 0, b"", np.zeros(0, np.int64)
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.concatenate((end_a, end_b))
        ends.sort(kind="stable")
        twice = ends[1:] == ends[:-1]
        common, ends = ends[1:][twice], ends[np.concatenate(([True], ~twice))]
        links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        upto_a, upto_b = np.searchsorted(end_a, common) + 1, np.searchsorted(end_b, common) + 1  # tokens up to each group's end
        entry_a, entry_b = a.copy(), b + 2 * len(self.a_bytes)
        entry_a[upto_a - 1] += len(self.a_bytes)
        entry_b[upto_b - 1] += len(self.b_bytes)
        entry = np.empty(len(a) + len(b), np.int64)
        entry[np.arange(len(a)) + np.repeat(np.concatenate(([0], upto_b[:-1])), np.diff(upto_a, prepend=0))] = entry_a
        entry[np.arange(len(b)) + np.repeat(upto_a, np.diff(upto_b, prepend=0))] = entry_b
        return len(common), b"".join(map(self.writing.__getitem__, entry.tolist()))[:-1], links


@dataclass
class Fragment:
    """What a byte range tells of the alignment.  ``closed`` is False where it holds no common end: all is in the head."""

    valid: bool = True
    closed: bool = False
    head: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    tail: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    written: list[bytes] = field(default_factory=list)
    links: Counter = field(default_factory=Counter)

    def add(self, pair: Pair, a: np.ndarray, b: np.ndarray) -> None:
        """Add the groups of two runs that begin and end together."""
        n_groups, written, links = pair.closed(a, b)
        self.n_a, self.n_b, self.n_groups = self.n_a + len(a), self.n_b + len(b), self.n_groups + n_groups
        if n_groups:
            self.written.append(written)
        self.links.update(links.tolist())


def compose(pair: Pair, parts: list[Fragment]) -> Fragment:
    """The fragment of neighbouring ranges, in order."""
    out = Fragment()
    for x in parts:
        out.valid = out.valid and x.valid
        side = out.tail if out.closed else out.head
        side[0].extend(x.head[0])
        side[1].extend(x.head[1])
        if not x.closed:
            continue
        if out.closed and side[0] and out.valid:
            out.add(pair, np.array(side[0], np.int64), np.array(side[1], np.int64))
        out.closed, out.tail = True, (list(x.tail[0]), list(x.tail[1]))
        out.n_a, out.n_b, out.n_groups = out.n_a + x.n_a, out.n_b + x.n_b, out.n_groups + x.n_groups
        out.written.extend(x.written)
        out.links.update(x.links)
    return out


def fragment_of(pair: Pair, stretch: str, low: int, high: int) -> Fragment:
    """The fragment of the bytes (low, high] of a stretch that begins with a space and ends at proven boundaries: of the
    tokens that end there."""
    ids = pair.ids(stretch)
    if ids is None:
        return Fragment(valid=False)
    a, b = ids
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    own_a, own_b = (end_a > low) & (end_a <= high), (end_b > low) & (end_b <= high)
    a, end_a, b, end_b = a[own_a], end_a[own_a], b[own_b], end_b[own_b]
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    if low > 0 and not len(common):
        return Fragment(head=(a.tolist(), b.tolist()))
    first = 0 if low <= 0 else common[0]  # the stretch's start is a common end
    last = common[-1] if len(common) else first
    out = Fragment(closed=True, head=(a[end_a <= first].tolist(), b[end_b <= first].tolist()), tail=(a[end_a > last].tolist(), b[end_b > last].tolist()))
    out.add(pair, a[(end_a > first) & (end_a <= last)], b[(end_b > first) & (end_b <= last)])
    return out


def chunks(text: str, size: int = CHUNK) -> Iterator[tuple[str, int, int]]:
    """Chunks of a text with a space before it: the stretch between proven boundaries around each, and its byte range."""
    whole = " " + text
    low = left = 0
    while low < len(whole):
        high = min(low + size, len(whole))
        far = BOUNDARY.search(whole, high)
        right = far.start() if far and high < len(whole) else len(whole)
        if right - high > size // 4:
            high = right
        yield whole[left:right], len(whole[left:low].encode()), len(whole[left:high].encode())
        low = high
        left = whole.rfind(" ", 0, min(low + 1, len(whole)))
        while left > 0 and (whole[left - 1].isspace() or not whole[left + 1:left + 2].strip()):
            left = whole.rfind(" ", 0, left)


_PAIRS: dict[str, Pair] = {}


def pair_of(a: bytes, b: bytes, pattern: str | None = None) -> Pair:
    """The worker's tokenizers."""
    name = hashlib.sha256(hashlib.sha256(a).digest() + hashlib.sha256(b).digest() + (pattern or "").encode()).hexdigest()
    if name not in _PAIRS:
        _PAIRS[name] = Pair(a, b, pattern)
    return _PAIRS[name]


PART = "kind int, batch long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"
FRAGMENT = ("doc long, seq long, valid boolean, closed boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, "
            "n_a long, n_b long, n_groups long, written binary, links binary, times binary")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def to_row(doc: int, seq: int, x: Fragment) -> dict:
    """A fragment as a row of ``FRAGMENT``."""
    return {"doc": doc, "seq": seq, "valid": x.valid, "closed": x.closed, "head_a": packed(x.head[0]), "head_b": packed(x.head[1]),
            "tail_a": packed(x.tail[0]), "tail_b": packed(x.tail[1]), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups,
            "written": b";".join(x.written), "links": np.array(list(x.links), "<u8").tobytes(), "times": np.array(list(x.links.values()), "<u8").tobytes()}


def from_row(row: dict) -> Fragment:
    links = Counter(dict(zip(np.frombuffer(row["links"], "<u8").tolist(), np.frombuffer(row["times"], "<u8").tolist())))
    return Fragment(row["valid"], row["closed"], (unpacked(row["head_a"]), unpacked(row["head_b"])), (unpacked(row["tail_a"]), unpacked(row["tail_b"])),
                    row["n_a"], row["n_b"], row["n_groups"], [row["written"]] if row["n_groups"] else [], links)


class Batch:
    """The documents of a batch with the dictionary of their id pairs."""

    def __init__(self, batch: int):
        self.batch, self.rows, self.links, self.times = batch, [], [], []

    def add(self, doc_id, n_a: int, n_b: int, n_groups: int, written: bytes, links: np.ndarray, times: np.ndarray) -> None:
        self.rows.append((0, self.batch, doc_id, n_a, n_b, n_groups, int(times.sum()), hashlib.sha256(written).hexdigest() if n_groups else ""))
        self.links.append(links)
        self.times.append(times)

    def table(self, schema: pa.Schema) -> pa.RecordBatch:
        """Rows of ``PART``: kind 0 for each document, then the dictionary as kind 1."""
        book, places = np.unique(np.concatenate(self.links), return_inverse=True)
        total = np.bincount(places, np.concatenate(self.times), len(book)).astype("<u8")
        cuts = np.cumsum([len(x) for x in self.links])[:-1]
        rows = [(*row, at.astype("<u4").tobytes(), times.astype("<u4").tobytes()) for row, at, times in zip(self.rows, np.split(places, cuts), self.times)]
        rows.append((1, self.batch, None, 0, 0, 0, 0, "", book.astype("<u8").tobytes(), total.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _short(rows: DataFrame, pair, kind: str) -> DataFrame:
    """Parts of documents that are folded where they are read."""
    schema = arrow_schema(PART.format(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair()
        for k, batch in enumerate(batches):
            out = Batch(TaskContext.get().partitionId() << 32 | k)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_values(batch.column("text"))):
                ids = own.ids(" " + text) if text else None
                if ids is None:
                    out.add(doc_id, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
                else:
                    n_groups, written, links = own.closed(*ids)
                    out.add(doc_id, len(ids[0]), len(ids[1]), n_groups, written, *np.unique(links, return_counts=True))
            yield out.table(schema)

    return rows.mapInArrow(run, PART.format(kind))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of long documents: ``doc``, ``seq``, the stretch and its byte range."""
    schema = arrow_schema("doc long, seq long, stretch string, low long, high long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                for seq, (stretch, low, high) in enumerate(chunks(text.as_py(), size)):
                    yield pa.RecordBatch.from_pylist([{"doc": doc, "seq": seq, "stretch": stretch, "low": low, "high": high}], schema=schema)

    return rows.select("doc", "text").mapInArrow(run, "doc long, seq long, stretch string, low long, high long")


def _long(rows: DataFrame, pair, kind: str, scratch: Scratch, size: int) -> DataFrame:
    """Parts of long documents: chunks over all tasks, then a tree of folds."""
    schema = arrow_schema(FRAGMENT)
    rows = rows.withColumn("doc", F.monotonically_increasing_id())
    dealt = scratch.keep("chunks", _dealt(scratch.keep("long", rows), size))
    names = scratch.spark.read.parquet(f"{scratch.root}/long").select("doc", "doc_id")

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair()
        for batch in batches:
            for row in batch.to_pylist():
                x = fragment_of(own, row["stretch"], row["low"], row["high"])
                yield pa.RecordBatch.from_pylist([to_row(row["doc"], row["seq"], x)], schema=schema)

    def fold(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["seq"])
        own = pair()
        return pa.Table.from_pylist([to_row(parts[0]["doc"], parts[0]["seq"] // FAN, compose(own, [from_row(r) for r in parts]))], schema=schema)

    level, step = scratch.keep("leaves", dealt.repartition("doc", "seq").mapInArrow(leaf, FRAGMENT)), 0
    while (most := level.agg(F.max("seq")).first()[0]) is not None and most > 0:
        folded = level.groupBy("doc", F.expr(f"seq div {FAN}").alias("of")).applyInArrow(fold, FRAGMENT)
        level, step = scratch.keep(f"fold{step}", folded), step + 1
    schema_out = arrow_schema(PART.format(kind))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, out = from_row(row), Batch(-1 - row["doc"])
                links = np.array(list(x.links.items()) if x.valid else [], np.int64).reshape(-1, 2)
                if x.valid:
                    out.add(row["doc_id"], x.n_a, x.n_b, x.n_groups, b";".join(x.written), links[:, 0], links[:, 1])
                else:
                    out.add(row["doc_id"], 0, 0, 0, b"", links[:, 0], links[:, 1])
                yield out.table(schema_out)

    return level.join(names, "doc").mapInArrow(rooted, PART.format(kind))


def pair_counts(books: DataFrame) -> DataFrame:
    """``pair``, its corpus-wide ``n``, and whether that is the highest of its B id, from the batches' dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n in zip(batch.column("places"), batch.column("times")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pairs.as_py(), "<i8")), pa.array(np.frombuffer(n.as_py(), "<i8"))], names=["pair", "n"])

    total = books.select("places", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return total.select("pair", "n", (F.col("n") == best).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of each document.

    ``a_path`` is a ``tokenizers`` file of a byte-level vocabulary, ``b_path`` a ``sentencepiece`` model that adds a space,
    both on the driver.  Given A's split ``pattern``, texts of characters below ``SETTLED`` are encoded with A's own
    vocabulary by ``tiktoken``, which is some three times as fast.
    """
    spark = docs.sparkSession
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read(), pattern))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "alignment")

    def pair() -> Pair:
        return pair_of(*shared.value)

    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    parts = scratch.keep("short", _short(rows.where(~is_long), pair, kind)).unionByName(scratch.keep("tall", _long(rows.where(is_long), pair, kind, scratch, chunk)))
    books = parts.where("kind = 1").select("batch", "places", "times")
    counts = scratch.keep("counts", pair_counts(books))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, pairs in zip(batch.column("batch").to_pylist(), batch.column("places")):
                pairs = np.frombuffer(pairs.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), own)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs)],
                                                 names=["batch", "place", "pair"])

    looked_up = books.select("batch", "places").mapInArrow(entries, "batch long, place int, pair long").join(counts, "pair").select("batch", "place", "n", "best")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    target = arrow_schema(schema)

    def judged(own: pa.Table, book: pa.Table) -> pa.Table:
        place = book.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = book.column("n").to_numpy(), book.column("best").to_numpy()
        sums = []
        for places, times in zip(own.column("places"), own.column("times")):
            at, many = np.frombuffer(places.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
            sums.append((int(many @ best[at]), int(many @ n[at])))
        out = {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64())}
        return pa.Table.from_arrays([out[f.name] if f.name in out else own.column(f.name) for f in target], schema=target)

    own = parts.where("kind = 0").drop("kind")
    return own.groupBy("batch").cogroup(looked_up.groupBy("batch")).applyInArrow(judged, schema)
