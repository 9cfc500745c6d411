"""Near duplicates, repeated strings, chat repair and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lakeforge.llm import bag_minhash, bpe_tree, chat_repair, quality_ledger, suffix_dedup
from lakeforge.llm.common import prepare

from .test_row_operators import plain_measure, plain_report
from .texts import ROWS


# ------------------------------------------------------------------ near duplicates

def bag(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def plain_classes(texts):
    """Index of the first member of each text's class."""
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or bags[i] and bags[j] and 5 * sum((bags[i] & bags[j]).values()) >= 4 * sum((bags[i] | bags[j]).values()):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(texts))]


def near_texts(seed, copies):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(300)]
    bases = [[r.choice(words) for _ in range(r.choice([1, 3, 8, 60, 150, 300]))] for _ in range(25)] + [["na"] * 40, ["na"] * 44, ["na"] * 80]
    texts = [" ".join(b) for b in bases]
    for _ in range(copies):
        b = list(bases[3] if r.random() < 0.5 else r.choice(bases))
        for _ in range(int(len(b) * r.choice([0, 0.005, 0.01, 0.02, 0.04]))):
            b[r.randrange(len(b))] = r.choice(words)
        texts.append(" ".join(b) + r.choice(["", " ", "\n"]))
    texts += [None, "", "  ", texts[3], texts[3].upper()]
    r.shuffle(texts)
    return texts


def test_signature_agreement_is_the_weighted_jaccard():
    r = random.Random(1)
    a = Counter({r.getrandbits(64): r.choice([1, 1, 2, 3, 9, 100]) for _ in range(60)})
    b = Counter({k: r.choice([v, v, v, 1, 5, 0]) for k, v in a.items()})
    b = +b
    both = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.int64)) for c in (a, b)]
    found = bag_minhash.signatures(both, 8192)
    assert float((found[0] == found[1]).mean()) == pytest.approx(sum((a & b).values()) / sum((a | b).values()), abs=0.025)


def test_near_duplicate_classes(spark):
    prepare(spark)
    texts = near_texts(3, 120)
    want = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "k", "key", "t1", "label", "n")}).repartition(4)
    got = {r.doc_id: r for r in bag_minhash.classes(docs).collect()}
    assert [got[k].class_id for k in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[k].class_docs == sizes[want[k]] for k in got)
    kept = bag_minhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_awkward_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    first = {}
    for i, t in ROWS:
        first[t or ""] = min((x for x in (first.get(t or ""), i) if x is not None), default=None)
    assert sorted(((r.doc_id, r.class_id) for r in bag_minhash.classes(docs).collect()), key=repr) == sorted(((i, first[t or ""]) for i, t in ROWS), key=repr)
    kept = sorted((((r.doc_id, r.text or "") for r in bag_minhash.deduplicated(docs).collect())), key=repr)
    assert kept == sorted(((i, t) for t, i in first.items()), key=repr)
    assert bag_minhash.classes(docs.limit(0)).count() == 0 and bag_minhash.deduplicated(docs.limit(0)).count() == 0


def copies_without_original(seed, copies, edits):
    """Near copies of a text that isn't among them; two copies are about as similar as a link asks."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    base = [r.choice(words) for _ in range(300)]
    texts = []
    for _ in range(copies):
        b = base[:]
        for _ in range(r.choice(edits)):
            b[r.randrange(len(b))] = r.choice(words)
        texts.append(" ".join(b))
    return texts


@pytest.mark.parametrize("copies,block", [(220, 400_000), (220, 6_000), (40, 1_000)])
def test_near_copies_without_their_original(spark, monkeypatch, copies, block):
    prepare(spark)
    monkeypatch.setattr(bag_minhash, "BLOCK", block)
    texts = copies_without_original(5, copies, [3, 4, 5, 6])
    want = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in bag_minhash.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_strays_find_their_links(spark, monkeypatch):
    """A chain of texts, each similar to its neighbours alone, around a group that most buckets belong to."""
    prepare(spark)
    monkeypatch.setattr(bag_minhash, "BLOCK", 2_000)
    r = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    chain = [[r.choice(words) for _ in range(300)]]
    for _ in range(30):
        b = chain[-1][:]
        for k in r.sample(range(300), 5):
            b[k] = r.choice(words)
        chain.append(b)
    texts = [" ".join(b) for b in chain] + copies_without_original(8, 60, [1, 2, 6, 9, 14])
    want = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in bag_minhash.classes(docs).collect()}
    assert len(set(want)) > 2 and [got[k] for k in range(len(texts))] == want


# ------------------------------------------------------------------ repeated strings

def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), bytes(v for v, g in zip(b, gone) if not g)))
    return out


def plain_kept(texts, length, min_words=0):
    """The texts without the repeated runs of more than ``min_words`` words, each kept part decoded alone."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        cuts = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        runs = [(x, y) for x, y in zip(cuts[::2], cuts[1::2]) if not min_words or len(b[x:y].split()) > min_words]
        ends = [0, *[e for r in runs for e in r], len(b)]
        out.append("".join(b[x:y].decode(errors="ignore") for x, y in zip(ends[::2], ends[1::2])))
    return out


def repeating_texts(seed, length):
    r = random.Random(seed)
    letters = "abé" if seed % 2 else "abcdefghijklmnop qrst"
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [some(r.randint(length - 10, 3 * length)) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(r.randint(0, 5)):
            k, s = r.random(), r.choice(shared)
            t += some(r.randint(0, 2 * length)) if k < 0.4 else s[r.randint(0, len(s) // 2):] if k < 0.8 else "a" * r.randint(1, 2 * length) if k < 0.9 else some(5) * r.randint(1, 30)
        texts.append(t)
    texts += [*texts[:3], None, "", some(length), some(length - 1) * 2]
    for _ in range(8):
        t = list(r.choice(texts) or "x")
        for _ in range(3):
            t[r.randrange(len(t))] = "z"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("seed,length", [(0, 40), (1, 40), (2, 400), (3, 400)])
def test_repeated_strings(spark, seed, length):
    prepare(spark)
    texts = repeating_texts(seed, length)
    want = plain_removal(texts, length)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string").withColumn("row", F.lit(0)).withColumn("body", F.lit(0)).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs, length).collect()}
    assert got == {k: (n, m, s, hashlib.sha256(b).hexdigest()) for k, (n, m, s, b) in enumerate(want)}
    if seed == 2:
        kept = suffix_dedup.removed(docs.withColumn("n_chars", F.lit(1).cast("long")), length)
        assert kept.columns == [*docs.columns, "n_chars"]
        rows = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
        left = plain_kept(texts, length)
        assert rows == {k: (None if t is None else left[k], len(left[k])) for k, t in enumerate(texts)}


def test_cut_characters_go():
    assert suffix_dedup.kept_text("aé--ñb".encode(), [(2, 6)]) == "ab"
    assert suffix_dedup.kept_text(b"one two three four", [(0, 7), (8, 18)], 2) == suffix_dedup.kept_text(b"one two three four", [], 2) == "one two three four"


def test_repeated_strings_of_awkward_rows(spark):
    prepare(spark)
    rows = [(i, t[:20_000] if t else t) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, n, m, s, hashlib.sha256(b).hexdigest()) for (i, _), (n, m, s, b) in zip(rows, plain_removal([t for _, t in rows], 400))]
    assert sorted(map(tuple, suffix_dedup.report(docs).collect()), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.report(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ chat

def cheapest(codes):
    best = None

    def go(k, state, cost):
        nonlocal best
        if k == len(codes):
            total = cost + chat_repair.INSERT * len(chat_repair.CLOSING[state])
            best = total if best is None else min(best, total)
            return
        for before, after, c, _, _ in chat_repair.MOVES[codes[k]]:
            if before == state:
                go(k + 1, after, cost + c)

    go(0, chat_repair.START, 0)
    return best


def test_chat_repair(spark):
    prepare(spark)
    r = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(r.choice([1, 2, 3, 5, 7]) if c else 1500):
            rows.append((c if c != 5 else None, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "tool", None, " Human", "GPT"]), r.choice(["a", "b\nx", "", None, "c" * 5])))
    df = spark.createDataFrame(rows + rows[:40], "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("seq", "cost", "first", "part", "pos", "n")})
    runs = [sorted(map(tuple, chat_repair.repair(df, p).collect()), key=lambda q: (q[0] is None, q[0] or 0, q[1])) for p in (1, 3, 30)]
    assert runs[0] == runs[1] == runs[2]
    talks = defaultdict(list)
    for q in runs[0]:
        talks[q[0]].append(q)
    given = [(c, t, role, x or "") for c, t, role, x in rows + rows[:40]]
    turns = [x for x in given if x[1] is None] + list({x for x in given if x[1] is not None})
    assert Counter(c for c, *_ in turns) == Counter({c: sum(q[6] != "insert" for q in v) for c, v in talks.items()})
    code = lambda s: {"system": 1, "user": 2, "assistant": 3, "human": 2, "gpt": 3}.get((s or "").strip().lower(), 4)
    for c, v in talks.items():
        assert [q[1] for q in v] == list(range(len(v)))
        roles = [q[5] for k, q in enumerate(v) if not k or v[k - 1][2] != q[2]]
        legal = roles[1:] if roles[0] == "system" else roles
        assert legal and legal == ["user", "assistant"] * (len(legal) // 2)
        if c != 0:
            assert v[0][7] == cheapest([code(q[4]) for q in v if q[6] != "insert"])
        text = "".join(q[8] for q in v)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(roles) and text.endswith("<|im_end|>\n")
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_equal_turns_without_a_number_are_kept(spark):
    prepare(spark)
    turns = [(1, None, "user", "yes"), (1, None, "user", "yes"), (1, None, "assistant", "ok"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, 2, "assistant", "b")]
    out = chat_repair.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r.rendered for r in out if r.conv_id == 1).count("yes") == 2
    assert "".join(r.rendered for r in sorted((r for r in out if r.conv_id == 2), key=lambda r: r.seq)).count("a<|im_end|>") <= 1


# ------------------------------------------------------------------ pipeline

def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(25)) for k in range(4)]
    passage, short = prose(56), prose(47)
    texts = [prose(r.randint(60, 200)) for _ in range(25)]
    texts += [texts[0], texts[0], texts[1] + " end", texts[2].replace(" ", "  "), prose(20), "spam " * 90, " ".join(w + "###" for w in prose(90).split()), None, ""]
    texts += [prose(70) + " " + passage + " " + prose(70), passage + " " + prose(90), prose(100) + " " + items[0][1], prose(80) + " " + items[1][1].upper() + " " + prose(60), prose(900) + " " + items[2][1][:60], prose(80) + " " + short + " " + prose(70), prose(60) + " " + short + " " + prose(90)]
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    order = docs[:]
    r.shuffle(order)
    spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def good(t):
        n, chars, symbols, dup, again, lines, marks = plain_measure(t or "")
        return not (n < 50 or 100 * again > 50 * n or symbols > n or 10 * marks > n or chars < 2 * n or chars > 20 * n or 10 * dup > 6 * lines)

    left = [(d[0], d[1]) for d in docs if good(d[1])]
    classes = plain_classes([t for _, t in left])
    left = [x for k, x in enumerate(left) if classes[k] == k]
    left = list(zip([i for i, _ in left], plain_kept([t for _, t in left], corpus_pipeline.REPEATED_BYTES, corpus_pipeline.REPEATED_WORDS)))
    dirty = {x[0] for x in plain_report(left, items) if x[5]}
    left = [x for x in left if x[0] not in dirty]
    ranks = bpe_tree.codec(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN).library
    assert isinstance(ranks, tiktoken.Encoding)
    want = {i: ranks.encode_to_numpy(t).astype("<u4").tobytes() for i, t in left}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id: bytes(x.ids) for x in got.collect()} == want
    assert 20 < len(want) < len(docs) - 8 and dirty
    assert not any(passage in t for _, t in left) and sum(short in t for _, t in left) == 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert quality_ledger.POLICIES["v1"]
