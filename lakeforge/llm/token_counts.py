"""Token counts by overlap resynchronisation.

A text is encoded in overlapping chunks, each from its own start, with the offset of every place where the encoder
begins anew (*stops*).  A chunk that starts inside a word begins wrongly, so neighbours are spliced at a stop that
both have and that lies far enough from the left chunk's end to be proven: there the left chunk is right, and from
there on the right chunk reads the same text from the same state.  Where an overlap holds no common stop it is
doubled; when it would reach the last splice, the left chunk is made longer instead, so a text that is one long word
is in the end encoded whole.  Memory follows the chunk, not the document.

Defined results: null and empty texts have 0 tokens; the strings of special tokens count as the library's default
has it (one token); repeated rows each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_values
from .pieces import Memo, split

#: Characters of a chunk and of the first overlap; characters before a chunk's end whose stops aren't proven
#: (longer than any special token, and than the pattern looks ahead).
CHUNK, OVERLAP, MARGIN = 65_536, 256, 64
#: A piece longer than this is encoded with the library's own offsets, for stops inside it.
LONG = 1024


class Counter:
    """Counts tokens with the ``tokenizers`` library."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(vocabulary)
        self.memo = Memo(lambda pieces: [len(e) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)])

    def stops(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Offsets at which the encoder begins anew, and the tokens from each to the next."""
        pieces = split(text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        if not len(pieces) or lengths.max() <= LONG:
            return starts, np.array(self.memo.of(pieces), np.int64)
        at, n = [], []
        short = iter(self.memo.of([p for p in pieces if len(p) <= LONG]))
        for start, piece in zip(starts.tolist(), pieces):
            if len(piece) <= LONG:
                at.append(start)
                n.append(next(short))
                continue
            found = self.library.encode(piece, add_special_tokens=False)
            word = None
            for k, w, (begin, _) in zip(range(len(found)), found.word_ids, found.offsets):
                if k and w is not None and w == word:
                    n[-1] += 1
                else:
                    at.append(start + begin)
                    n.append(1)
                word = w
        return np.array(at, np.int64), np.array(n, np.int64)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
        """Tokens of a text, spliced from chunks."""
        if len(text) <= chunk:
            return sum(self.memo.of(pieces)) if max(map(len, pieces := split(text)), default=0) <= LONG else int(self.stops(text)[1].sum())
        total, begin, end = 0, 0, chunk
        at, n = self.stops(text[:end])
        while end < len(text):
            wide, spliced = overlap, None
            while spliced is None and end - wide > begin:
                base, far = end - wide, min(len(text), end - wide + max(chunk, 2 * wide))
                own, own_n = self.stops(text[base:far])
                common = np.intersect1d(at[(at > begin) & (at < end - margin)], own[own > 0] + base, assume_unique=True)
                spliced = int(common[0]) if len(common) else None
                wide *= 2
            if spliced is None:  # no common stop back to the last splice: a longer left chunk
                end = min(len(text), begin + 2 * (end - begin))
                at, n = self.stops(text[begin:end])
                at = at + begin
                continue
            total += int(n[(at >= begin) & (at < spliced)].sum())
            begin, end, at, n = spliced, far, own + base, own_n
        return total + int(n[at >= begin].sum())


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: bytes) -> Counter:
    """The worker's counter of a vocabulary."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(vocabulary)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of each document.

    ``vocabulary_path`` is a ``tokenizers`` file on the driver; its content (some 2 MB) is broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        own = counter(shared.value)
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "n_tokens": [own.count(t, chunk, overlap) for t in text_values(batch.column("text"))]}

    return map_batches(rows, work, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
