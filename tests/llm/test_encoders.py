"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeforge.llm import bpe_tree, pieces, token_counts
from lakeforge.llm.common import prepare

from .texts import ROWS, awkward

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SAMPLES = [awkward(k, n) for k in range(40) for n in (3, 60, 400)] + [t or "" for _, t in ROWS if len(t or "") < 50_000] + [
    "日本語" * 3000, "a" * 5000, "  " * 3000, "word  \n" * 900, "<|endoftext|>" * 200, "x <|endoftext|> y" * 100, "'ll" * 900]


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(open(JSON, "rb").read())


@pytest.fixture(scope="module")
def codec():
    return bpe_tree.codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_the_text():
    for text in SAMPLES:
        assert "".join(pieces.split(text)) == text


@pytest.mark.parametrize("chunk,overlap,margin", [(65_536, 256, 64), (200, 20, 16), (90, 30, 20), (40, 4, 16)])
def test_spliced_counts_are_the_library_s(counter, chunk, overlap, margin):
    library = Tokenizer.from_file(JSON)
    for text in SAMPLES:
        assert counter.count(text, chunk, overlap, margin) == len(library.encode(text, add_special_tokens=False)), (chunk, text[:80])


@pytest.mark.parametrize("leaf", [16_384, 64, 7, 1])
def test_tree_is_the_library_s_encoding(codec, ranked, leaf):
    for text in SAMPLES if leaf > 10 else SAMPLES[::4]:
        ids = codec.encode(text[:2000] if leaf < 10 else text, leaf)
        assert ids == ranked.encode_to_numpy(text[:2000] if leaf < 10 else text).astype("<u4").tobytes(), (leaf, text[:80])
        assert codec.decode(ids, 5) == (text[:2000] if leaf < 10 else text).encode()


def test_memo_forgets_and_stays_right(counter, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 20)
    library = Tokenizer.from_file(JSON)
    for text in SAMPLES[:30]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False))


def test_queries_on_awkward_rows(spark, ranked):
    prepare(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("n_bytes", F.lit(None)).repartition(3)
    library = Tokenizer.from_file(JSON)
    counts = sorted(map(tuple, token_counts.count_tokens(docs, JSON).collect()), key=repr)
    want = []
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert counts == sorted(want, key=repr)
    both = sorted(map(tuple, bpe_tree.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t in ROWS:
        ids = ranked.encode_to_numpy(t or "")
        want.append((i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert both == sorted(want, key=repr)
    steps = bpe_tree.decode_documents(bpe_tree.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in steps.collect()), key=repr) == both
    none = docs.limit(0)
    assert token_counts.count_tokens(none, JSON).count() == 0
    assert bpe_tree.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_workers_keep_no_encodings_of_a_task(spark):
    import pyarrow as pa

    prepare(spark)
    docs = spark.createDataFrame([(k, awkward(k, 300)) for k in range(40)], "doc_id long, text string").repartition(8)
    assert bpe_tree.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).count() == 40

    def run(batches):
        from lakeforge.llm import bpe_tree as own

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(c.memo.known) for c in own._CODECS.values())], pa.int64())})

    left = [r.n for r in spark.range(800, numPartitions=8).mapInArrow(run, "n long").collect()]
    assert len(left) == 8 and max(left) == 0
