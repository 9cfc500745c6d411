"""Exact repeated strings by distributed prefix doubling over sampled suffixes.

Every byte covered by a string of ``length`` bytes (400) that also starts anywhere else is removed.

A full suffix array of the corpus would sort a row per byte.  Here suffixes are sorted only at *anchors*: the position
of the least 16-gram hash in each window of ``length // 4 - 4`` positions.  An anchor depends on nothing but the bytes
around it, so two equal strings hold the same anchors, and every string of 400 bytes has an anchor near its start.
About one position in fifty is an anchor, and all work below is on them:

1.  *Doubling.*  A suffix's first rank is that of the block from its anchor to the next.  Each round pairs the rank at
    an anchor with the rank as many blocks further on as the rank covers, ranks the pairs anew, and drops every suffix
    whose rank is unique, until a rank covers more than the part of a 400-byte string that is sure to follow its
    anchor.  A rank is the least position that has the pair.  Ranking is an aggregation with map-side combine that is
    written down, and a join to it that Spark splits where one pair is very frequent.  What is dropped cannot start a
    repeated string.
2.  *Whole stretches.*  The string that holds every 400-byte string assigned to an anchor: if it is repeated, all are.
3.  *Edges.*  Where it isn't, but the rank is, a repeat ends nearby.  There the stretch is cut into eighths.  An eighth
    is dropped if what its strings have in common isn't repeated, settled if its own stretch is, and only else are its
    400-byte strings compared one by one.  Of a stretch that is repeated, one occurrence stands for all.

Texts are told apart by a 128-bit key of what they say, not by their ids; exact copies are one text, whose every byte
goes if it has 400 bytes or more.  Steps 2 and 3 compare 128-bit fingerprints.  Each step is written to the shared
folder, so a lost executor costs one step at most.

Defined results: a null text is empty; texts shorter than 400 bytes keep every byte; repeated rows are copies of one
another; matches never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, giving_back, map_batches, text_bytes, text_key

LENGTH = 400
#: What tells an anchor from all others.
SPOT = ["t1", "t2", "place"]
#: Bytes of concatenated texts that are sampled at a time (one longer text is taken alone).
GROUP = 1 << 20

_rng = np.random.default_rng(20011)
BYTE = _rng.integers(0, 2**64, 256, np.uint64)
BASES = _rng.integers(0, 2**64, 2, np.uint64) | np.uint64(1)
STEPS = _rng.integers(0, 2**64, 8, np.uint64) | np.uint64(1)
MIX = np.uint64(0xD6E8FEB86659FD93)


def shape(length: int) -> tuple[int, int]:
    """(window, gram): positions an anchor is the least of, and bytes of a gram."""
    return max(2, length // 4 - length // 100), 16 if length >= 200 else 4


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def packed(begin: np.ndarray, many: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Some strings of an anchor as one number: where the first starts, how many they are, and how far on the anchor is."""
    return (begin * 128 + many) * 128 + ahead


#: The parts of a packed number in SQL.
BEGIN, MANY = "own div 16384", "own div 128 % 128"


class Powers:
    """Powers of the two bases and of their inverses modulo 2^64, grown as needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if n > self.n:
            self.n = max(n, GROUP + 1, 2 * self.n)
            self.up = [self._run(int(b)) for b in BASES]
            self.down = [self._run(pow(int(b), -1, 2**64)) for b in BASES]
        return self.up, self.down

    def _run(self, base: int) -> np.ndarray:
        out = np.ones(self.n, np.uint64)
        k = 1
        while k < self.n:
            out[k:2 * k] = out[:min(k, self.n - k)] * np.uint64(pow(base, k, 2**64))
            k *= 2
        return out


_POWERS = Powers()


class Prints:
    """Fingerprints of any stretch of a byte string from prefix sums."""

    def __init__(self, values: np.ndarray, bases: int = 2):
        self.up, self.down = _POWERS.upto(len(values) + 1)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.up[b][:len(values)]))) for b in range(bases)]

    def of(self, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        h = (self.sums[base][end] - self.sums[base][begin]) * self.down[base][begin]
        return mixed(h + (end - begin).astype(np.uint64) * MIX).view(np.int64)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window of ``width`` positions."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(texts: list[bytes], length: int, stretches: bool) -> dict[str, np.ndarray]:
    """A row per anchor of texts of ``length`` bytes or more.

    ``text`` (its index), ``place`` (2 x number of the anchor in its text, plus 1 if the third rank is decided within
    what follows the anchor in every string assigned to it), ``name`` (fingerprint of the block to the next anchor),
    ``own`` (the strings assigned to it, see :func:`packed`), and if ``stretches``, ``f1 f2`` (their stretch's print).
    """
    window, gram = shape(length)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    values = BYTE[raw]
    h, k = values, 1
    while k < gram:
        h = h[:-k] * STEPS[k.bit_length()] + h[k:]
        k *= 2
    h = mixed(h)
    pick = least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), window) & np.uint64(0xFFFFFFFF)
    pick = pick.astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    inside = np.zeros(len(pick), bool)
    first = np.concatenate(([True], pick[1:] != pick[:-1]))
    for o, n in zip(offsets.tolist(), sizes.tolist()):
        inside[o:o + n - window - gram + 2] = True
        first[o] = True
    begin = np.flatnonzero(first & inside)
    at = pick[begin]
    text = np.searchsorted(offsets, begin, "right") - 1
    # blocks end at the next anchor of the same text
    follows = np.zeros(len(begin), bool)
    follows[:-1] = text[1:] == text[:-1]
    last_string = offsets[text] + sizes[text] - length
    end = np.minimum(np.where(follows, np.append(begin[1:], 0) - 1, last_string), last_string)
    many = np.maximum(0, end - begin + 1)
    number = np.arange(len(begin)) - np.searchsorted(text, text, "left")
    third = np.full(len(begin), 2**62)
    if len(begin) > 3:
        third[:-3] = np.where(text[3:] == text[:-3], at[3:], 2**62)
    decided = third + window + gram <= at + length - window + 1
    prints = Prints(values, 2 if stretches else 1)
    keep = np.flatnonzero(follows)
    out = {"text": text[keep], "place": (2 * number + decided)[keep], "name": prints.of(at[keep], at[keep + 1], 0),
           "own": packed(begin - offsets[text], many, at - begin)[keep]}
    if stretches:
        stop = np.where(many > 0, end + length, begin)[keep]
        out |= {"f1": prints.of(begin[keep], stop, 0), "f2": prints.of(begin[keep], stop, 1)}
    return out


def sampled(docs: DataFrame, length: int, stretches: bool) -> DataFrame:
    """Anchor rows of all texts (``t1``, ``t2``, ``text``); a text that a task meets again is skipped."""
    assert shape(length)[0] < 128
    schema = "name long, t1 long, t2 long, place long, own long" + ", f1 long, f2 long" * stretches
    target = arrow_schema(schema)

    def rows(texts: list[bytes], keys: list[tuple[int, int]]) -> pa.RecordBatch:
        found = anchors(texts, length, stretches)
        which = found.pop("text")
        both = np.array(keys, np.int64)[which]
        found |= {"t1": both[:, 0], "t2": both[:, 1]}
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts, keys, size = [], [], 0
            for key, text in zip(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist()), text_bytes(batch.column("text"))):
                if key in seen:
                    continue
                seen.add(key)
                if texts and size + len(text) > GROUP:
                    yield rows(texts, keys)
                    texts, keys, size = [], [], 0
                texts.append(text)
                keys.append(key)
                size += len(text)
            if texts:
                yield rows(texts, keys)

    return docs.where(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(giving_back(run), schema)


def ranked(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The keys that stand at more than one spot, with their rank ``new``: the least spot."""
    spots = rows.select(*keys, F.xxhash64(*SPOT).alias("spot"))
    found = spots.groupBy(*keys).agg(F.min("spot").alias("new"), F.max("spot").alias("top"))
    return scratch.keep(name, found.where("new < top").drop("top"))


def reranked(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose pair of ranks (``rank``, ``next``) stands elsewhere too, with the pair's rank."""
    pair = ["rank", "next"]
    return rows.join(ranked(rows, pair, scratch, name), pair).drop(*pair).withColumnRenamed("new", "rank")


def cut_at(asked: DataFrame, length: int, width: int) -> DataFrame:
    """The asked strings in parts of up to ``width`` starts, counted from the anchor so that copies are cut alike.

    A row per part: ``g1 g2`` (print of what all strings of a whole part have in common), ``f1 f2`` (print of the
    stretch that this part's strings cover), the text's key, ``own`` and ``known``.
    """
    schema = "g1 long, g2 long, f1 long, f2 long, t1 long, t2 long, own long, known boolean"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, places in zip(*(batch.column(n) for n in ("t1", "t2", "text", "places"))):
                prints = Prints(BYTE[np.frombuffer(text.as_py().encode(), np.uint8)])
                own = np.array([p["own"] for p in places.as_py()], np.int64)
                known = np.array([p["known"] for p in places.as_py()], bool)
                first, many, ahead = own >> 14, own >> 7 & 127, own & 127
                # strings of part k start from ``at - k * width - width + 1`` to ``at - k * width``
                low = (ahead - many + 1) // width
                parts = ahead // width - low + 1
                which = np.repeat(np.arange(len(own)), parts)
                k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts) + low[which]
                last = (first + ahead)[which] - k * width
                begin = np.maximum(first[which], last - width + 1)
                end = np.minimum((first + many - 1)[which], last)
                for a in range(0, len(which), 100_000):
                    w, b, e, z = which[a:a + 100_000], begin[a:a + 100_000], end[a:a + 100_000], last[a:a + 100_000]
                    common = z - width + 1 + length
                    columns = [prints.of(z, common, 0), prints.of(z, common, 1), prints.of(b, e + length, 0), prints.of(b, e + length, 1),
                               np.full(len(w), t1.as_py()), np.full(len(w), t2.as_py()), packed(b, e - b + 1, (first + ahead)[w] - b), known[w]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return asked.mapInArrow(giving_back(run), schema)


def again(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The keys that stand at more than one spot, or at one that stands for others; ``low`` is the least spot."""
    spots = rows.select(*keys, "known", F.xxhash64("t1", "t2", "own").alias("spot"))
    found = spots.groupBy(*keys).agg(F.min("spot").alias("low"), F.max("spot").alias("top"), F.max("known").alias("known"))
    return scratch.keep(name, found.where("low < top or known").select(*keys, "low"))


def settled(rows: DataFrame, group: list[str], length: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans of repeated stretches, what has to be asked more closely).

    Asked are the strings of stretches that aren't repeated, and, as known ones, those of one occurrence of each
    repeated stretch of the same group.
    """
    found = rows.join(again(rows, ["f1", "f2"], scratch, f"{name}-again"), ["f1", "f2"], "left")
    stands = F.col("known") | (F.xxhash64("t1", "t2", "own") == F.col("low"))
    found = scratch.keep(name, found.select("t1", "t2", "own", *group, "known", F.col("low").isNotNull().alias("whole"), stands.alias("stands")))
    spans = found.where("whole and not known").selectExpr("t1", "t2", f"{BEGIN} AS begin", f"{BEGIN} + {MANY} - 1 + {length} AS end")
    edges = found.where("not whole")
    stand = found.where("whole and stands").join(edges.select(*group).distinct(), group, "left_semi")
    asked = edges.select("t1", "t2", "own", F.lit(False).alias("known")).unionByName(stand.select("t1", "t2", "own", F.lit(True).alias("known")))
    return spans, asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("own", "known")).alias("places"))


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``t1``, ``t2`` and ``spans`` (begin, end) of the repeated strings of each text that has any.

    ``docs`` has ``t1``, ``t2`` (key of the text) and ``text`` without nulls.
    """
    scratch = Scratch(docs.sparkSession, "suffix")

    # round 0: the block at each anchor
    ranks = ranked(sampled(docs, length, False), ["name"], scratch, "ranks0")
    rows = scratch.keep("round0", sampled(docs, length, True).join(ranks, "name").drop("name").withColumnRenamed("new", "rank"))
    # round 1: pairs of blocks; copies of a text that other tasks met are dropped on the way
    rows = rows.repartition("t1", "t2").dropDuplicates(SPOT)
    order = Window.partitionBy("t1", "t2").orderBy("place")
    number = F.expr("place div 2")
    rows = rows.withColumn("n", number).withColumn("next", F.when(F.lead("n").over(order) == F.col("n") + 1, F.lead("rank").over(order)))
    rows = scratch.keep("pairs1", rows.where("next is not null").drop("n"))
    scratch.drop("round0", "ranks0")
    rows = scratch.keep("round1", reranked(rows, scratch, "ranks1"))
    scratch.drop("pairs1", "ranks1")
    # round 2: pairs of pairs, where what follows the anchor decides them; other suffixes are past the threshold
    rows = rows.withColumn("n", number)
    ahead = F.coalesce(*[F.when(F.lead("n", k).over(order) == F.col("n") + 2, F.lead("rank", k).over(order)) for k in (1, 2)])
    rows = scratch.keep("pairs2", rows.withColumn("next", ahead).drop("n").where(f"{MANY} > 0 or next is not null"))
    scratch.drop("round1")
    due = rows.where("place % 2 = 1 and next is not null")
    done = rows.where("place % 2 = 0").withColumn("rank", F.xxhash64("rank", F.lit(1))).drop("next")
    rows = scratch.keep("round2", reranked(due, scratch, "ranks2").unionByName(done).where(f"{MANY} > 0"))
    scratch.drop("pairs2", "ranks2")
    # whole stretches, then eighths of them, then single strings
    rows = rows.select("t1", "t2", "own", "f1", "f2", "rank", F.lit(False).alias("known"))
    whole, asked = settled(rows, ["rank"], length, scratch, "stretches")
    one = docs.withColumn("k", F.row_number().over(Window.partitionBy("t1", "t2").orderBy(F.lit(1)))).where("k = 1").select("t1", "t2", "text")
    texts = scratch.keep("texts", one.join(asked, ["t1", "t2"]))
    scratch.drop("round2")
    group = ["g1", "g2"]
    parts = scratch.keep("parts", cut_at(texts, length, max(1, shape(length)[0] // 8)))
    eighths, asked = settled(parts.join(again(parts, group, scratch, "common"), group, "left_semi"), group, length, scratch, "eighths")
    strings = scratch.keep("strings", cut_at(texts.drop("places").join(asked, ["t1", "t2"]), length, 1))
    single = strings.where("not known").join(again(strings, ["f1", "f2"], scratch, "twice"), ["f1", "f2"], "left_semi")
    single = single.selectExpr("t1", "t2", f"{BEGIN} AS begin", f"{BEGIN} + {length} AS end")
    # copies of a whole text
    copies = docs.where(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("end"))
    copies = copies.where("n > 1").select("t1", "t2", F.lit(0).cast("long").alias("begin"), "end")
    spans = whole.unionByName(eighths).unionByName(single).unionByName(copies).groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    spans = scratch.keep("spans", spans)
    scratch.drop("stretches", "stretches-again", "texts", "parts", "common", "eighths", "eighths-again", "strings", "twice")
    return spans


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Disjoint maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        end = min(end, size)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for begin, end in runs:
        kept.append(text[at:begin])
        at = end
    return b"".join([*kept, text[at:]])


def _marked(docs: DataFrame, length: int, text_col: str = "text") -> DataFrame:
    """``row`` (the document as a struct), ``body`` (its text, null as empty) and ``spans``."""
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    t1, t2 = text_key(body)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"), t1.alias("t1"), t2.alias("t2"))
    spans = marks(rows.select("t1", "t2", F.col("body").alias("text")), length)
    return rows.join(spans, ["t1", "t2"], "left").select("row", "body", "spans")


def _runs(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    return merged([(s["begin"], s["end"]) for s in spans or ()], size)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, digest of what remains."""
    found = _marked(docs.select("doc_id", "text"), length).select("row.doc_id", "body", "spans")
    kind = found.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column("body"))
        runs = [_runs(s, len(t)) for s, t in zip(batch.column("spans").to_pylist(), texts)]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "n_removed": [sum(e - b for b, e in r) for r in runs],
                "n_spans": [len(r) for r in runs], "kept_sha256": [hashlib.sha256(cut(t, r)).hexdigest() for t, r in zip(texts, runs)]}

    return map_batches(found, work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(text: bytes, runs: list[tuple[int, int]], min_words: int = 0) -> str:
    """The text without the runs of more than ``min_words`` words; a character that a run cuts in two goes too."""
    parts, at = [], 0
    for begin, end in runs:
        if not min_words or len(text[begin:end].split()) > min_words:
            parts.append(text[at:begin])
            at = end
    return "".join(part.decode(errors="ignore") for part in [*parts, text[at:]])


def removed(docs: DataFrame, length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """The documents, all columns and rows, with the repeated bytes gone from ``text`` and ``n_chars`` counted anew.

    With ``min_words``, of the runs that repeated strings of ``length`` bytes cover only those of more words go.  A
    character that a run cuts in two goes too.
    """
    found = _marked(docs, length)
    kind = found.schema["row"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column("row"), "kept": [kept_text(t, _runs(s, len(t)), min_words)
                                                     for t, s in zip(text_bytes(batch.column("body")), batch.column("spans").to_pylist())]}

    out = map_batches(found, work, f"row {kind}, kept string")
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return out.select(*[new[c] if c in new else F.col(f"row.`{c}`") for c in docs.columns])
