"""Byte-level BPE by a monoid tree.

A text is halved until a leaf is short.  A leaf is encoded alone; two neighbours are joined by encoding a window around
their boundary anew.  The window begins at a proven boundary of the left node, so everything before it stands; it grows
to the right until it has a proven boundary in common with the right node, from which everything stands too.  Joining is
associative, so the result doesn't depend on where the text was halved.  Decoding splits the ids into leaves and
concatenates the bytes up the tree.

Defined results: null and empty texts give no ids and no bytes; special tokens are never produced; repeated rows each
get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_values
from .pieces import Memo, split

#: Characters of a leaf; ids of a leaf of decoding.
LEAF, LEAF_IDS = 16_384, 4_096


@dataclass
class Node:
    """An encoded span: its pieces, and the ids of each as little-endian 32-bit integers."""

    pieces: list[str]
    ids: list[bytes]


class Codec:
    """Encodes and decodes by a rank file and a split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.memo = Memo(lambda pieces: [self.library.encode_to_numpy(p).astype("<u4").tobytes() for p in pieces])

    def leaf(self, text: str) -> Node:
        pieces = split(text)
        return Node(pieces, self.memo.of(pieces))

    def join(self, left: Node, right: Node) -> Node:
        if not left.pieces or not right.pieces:
            return left if left.pieces else right
        # A left piece is proven if text follows its closing space; only the last one can change, or the last two
        # where the left span ends in that space's neighbourhood.
        grow = 2
        while True:
            a, b = max(0, len(left.pieces) - grow), min(len(right.pieces), grow)
            head = "".join(left.pieces[a:])
            window = self.leaf(head + "".join(right.pieces[:b]))
            if a == 0 and b == len(right.pieces):
                return Node(window.pieces, window.ids)
            stop = self._common(window, len(head), right, b)
            if stop is not None:
                kept, skip = stop
                return Node(left.pieces[:a] + window.pieces[:kept] + right.pieces[skip:], left.ids[:a] + window.ids[:kept] + right.ids[skip:])
            grow *= 2

    @staticmethod
    def _common(window: Node, boundary: int, right: Node, b: int) -> tuple[int, int] | None:
        """(pieces of the window to keep, pieces of the right node to skip) at a boundary that both have."""
        if b == len(right.pieces):
            return len(window.pieces), b
        places, at = {}, boundary
        for k, piece in enumerate(right.pieces[:b]):
            if k:
                places[at] = k
            at += len(piece)
        at = 0
        for k, piece in enumerate(window.pieces):
            if at in places:
                return k, places[at]
            at += len(piece)
        return None

    def tree(self, text: str, leaf: int = LEAF) -> Node:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half], leaf), self.tree(text[half:], leaf))

    def encode(self, text: str, leaf: int = LEAF) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.tree(text, leaf).ids)

    def decode(self, ids: bytes, leaf: int = LEAF_IDS) -> bytes:
        """The bytes of packed ids, concatenated up the tree."""
        n = len(ids) // 4
        if n <= leaf:
            return self.library.decode_bytes(np.frombuffer(ids, "<u4").tolist())
        half = 4 * (n // 2)
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


_CODECS: dict[str, Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """The worker's codec of a rank file."""
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, pattern)
    return _CODECS[name]


def share(df: DataFrame, path: str):
    """The content of a rank file (under 1 MB) as a broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers) of each document."""
    shared = share(docs, ranks_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        own = codec(shared.value, pattern)
        ids = [own.encode(t, leaf) for t in text_values(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids}

    def done() -> None:
        codec(shared.value, pattern).memo.known.clear()

    return map_batches(rows, work, f"doc_id {kind}, n_tokens long, ids binary", done)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The encoded documents with ``decoded``, the bytes of their ids."""
    shared = share(encoded, ranks_path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        own = codec(shared.value, pattern)
        return {n: batch.column(n) for n in ("doc_id", "n_tokens", "ids")} | {"decoded": [own.decode(i) for i in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "n_tokens", "ids"), work, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of each document, by one codec in one pass."""
    shared = share(docs, ranks_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        own = codec(shared.value, pattern)
        ids = [own.encode(t) for t in text_values(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": [own.decode(i) for i in ids]}

    def done() -> None:
        codec(shared.value, pattern).memo.known.clear()

    return map_batches(rows, work, f"doc_id {kind}, n_tokens long, ids binary, decoded binary", done)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes, decodes, and returns ``doc_id``, ``n_tokens`` and the digests of ids and decoded bytes."""
    both = encode_and_decode(docs, ranks_path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
