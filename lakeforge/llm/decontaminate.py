"""Benchmark decontamination by broadcast n-gram sets.

The benchmark's normalised windows (13 words; an item of fewer words is one window) are gathered in blocks of at most
``block_windows`` windows.  Each block is one broadcast, and a block is destroyed before the next is sent, so what is
broadcast at any time has a fixed bound however large the benchmark is; documents are scanned once per block, and the usual
benchmark is one block.  Of several blocks, the hits are written by the text's key and joined to the documents at the end.
A document's windows are looked up by a 64-bit key and every hit is then verified word by word, so no result rests on a hash.

Words: A-Z is lower-cased, a word is a run of digits, a-z and characters from U+0080 on.  On UTF-8 bytes that is a
run of ``0-9 a-z \\x80-\\xff``.

Defined results: null and empty texts have no words, no hits and are clean.  An item without words has no window.
A null item id still marks words but lists no id.  Repeated documents each get a row; repeated items count once.
An empty benchmark hits nothing.  Extra columns are kept where rows are filtered and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, text_bytes, text_key

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: At most this many windows in one broadcast: 13 word numbers and a key each, under 60 MB.
BLOCK_WINDOWS = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


class Block:
    """A bounded set of windows: word numbers, and per window length the sorted keys with their word rows and items."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], tuple[str, ...]]]] = {}
        for window, items in windows.items():
            ids = [self.number.setdefault(w, len(self.number)) for w in window]
            by_length.setdefault(len(window), []).append((ids, tuple(sorted(items))))
        self.sets = []
        for length, rows in sorted(by_length.items()):
            ids = np.array([r[0] for r in rows], np.int64)
            keys = window_keys(ids.reshape(-1), length)[::length]
            order = np.argsort(keys, kind="stable")
            self.sets.append((length, keys[order], ids[order], [rows[k][1] for k in order]))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Verified occurrences: merged [start, end) word spans, and the items."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for length, keys, rows, names in self.sets:
            if len(words) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            own = window_keys(ids, length)[starts]
            at = np.searchsorted(keys, own)
            for k in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == own):
                s, p = int(starts[k]), at[k]
                while p < len(keys) and keys[p] == own[k]:
                    if np.array_equal(rows[p], ids[s:s + length]):
                        spans.append((s, s + length))
                        items.update(names[p])
                        break
                    p += 1
        return merge(spans), items


def window_keys(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of every window of ``length`` word numbers."""
    ids = ids.astype(np.uint64) + np.uint64(1)
    keys = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for k in range(length):
        keys = keys * MULTIPLIER + ids[k:k + len(keys)]
    return keys ^ (keys >> np.uint64(29))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, sorted, maximal spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark's windows in blocks of bounded size, streamed one partition at a time through the driver."""
    gathered: dict[tuple[bytes, ...], set[str]] = {}
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        for s in range(max(1, len(words) - window + 1) if words else 0):
            gathered.setdefault(tuple(words[s:s + window]), set()).update([row.i] if row.i is not None else [])
            if len(gathered) >= block_windows:
                yield Block(gathered)
                gathered = {}
    if gathered:
        yield Block(gathered)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``row`` (the document as a struct), ``n_words``, ``spans`` (merged hit word spans) and ``items`` per document."""
    spark = docs.sparkSession
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema["row"].dataType
    schema = f"row {kind.simpleString()}, n_words long, spans array<long>, items array<string>"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(None).cast("long").alias("n_words"),
                       F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))

    def scanner(shared):
        def work(batch: pa.RecordBatch) -> dict:
            found = [(len(w := words_of(t)), *(shared.value.scan(w) if shared is not None else ([], set())))
                     for t in text_bytes(batch.column("row").field("text"))]
            spans = [merge(s + list(zip(old[::2], old[1::2]))) for (_, s, _), old in zip(found, batch.column("spans").to_pylist())]
            return {"row": batch.column("row"), "n_words": [f[0] for f in found], "spans": [[x for s in own for x in s] for own in spans],
                    "items": [sorted(set(old) | f[2]) for f, old in zip(found, batch.column("items").to_pylist())]}
        return work

    parts = blocks(benchmark, window, block_windows)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return map_batches(rows, scanner(None if first is None else spark.sparkContext.broadcast(first)), schema)
    # several blocks: one at a time, each is gone before the next is sent; only hits are kept, under the text's key
    scratch = Scratch(spark, "decontaminate")
    t1, t2 = text_key(F.coalesce(F.col("row.text"), F.lit("")))
    texts = rows.select(F.struct(F.col("row.text").alias("text"), t1.alias("t1"), t2.alias("t2")).alias("row"), "n_words", "spans", "items")
    hits = []
    for k, block in enumerate(chain([first, second], parts)):
        shared = spark.sparkContext.broadcast(block)
        found = map_batches(texts, scanner(shared), schema.replace(kind.simpleString(), texts.schema["row"].dataType.simpleString(), 1))
        hits.append(scratch.keep(f"hits{k}", found.where("size(spans) > 0").select("row.t1", "row.t2", "spans", "items").dropDuplicates(["t1", "t2"])))
        shared.destroy()
    every = reduce(DataFrame.unionByName, hits).groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    both = rows.select("row", "n_words", t1.alias("t1"), t2.alias("t2")).join(every, ["t1", "t2"], "left")
    empty = {c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("spans", "long"), ("items", "string"))}
    return map_batches(both.withColumns(empty).select("row", "n_words", "spans", "items"), scanner(None), schema)


def judged(scanned: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``n_items`` and ``contaminated`` (a hit, and at least a twentieth of the words hit)."""
    ends = F.expr("aggregate(sequence(0, cast(size(spans) / 2 as int) - 1), 0L, (n, k) -> n + spans[2 * k + 1] - spans[2 * k])")
    hit = F.when(F.size("spans") > 0, ends).otherwise(F.lit(0).cast("long"))
    return scanned.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: the hits and the judgement."""
    found = judged(scan(docs.select("doc_id", "text"), benchmark, **how))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return judged(scan(docs, benchmark, **how)).where(~F.col("contaminated")).select("row.*")


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORDS.finditer(text.lower())]
    kept, at = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        kept.append(text[at:places[s][0]])
        at = places[e - 1][1]
    return b"".join([*kept, text[at:]])


def cut_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``doc_id`` and the text with every hit span removed."""
    found = scan(docs.select("doc_id", "text"), benchmark, **how).select("row.doc_id", "row.text", "spans")
    kind = found.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"),
                "text": [cut(t, s).decode() for t, s in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist())]}

    return map_batches(found, work, f"doc_id {kind}, text string")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, gram)),
s AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
