"""Token alignment, ranked search and personal data against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import personal_data, ranked_search, token_alignment
from lakeforge.llm.common import prepare

from .texts import ROWS, awkward

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return token_alignment.pair_of(open(A, "rb").read(), open(B, "rb").read())


# ------------------------------------------------------------------ token alignment

def plain_alignment(pair, text):
    """(n_a, n_b, groups written out, link counts) of a text by the libraries and every pair of a group."""
    raw = (" " + (text or "")).encode()
    if not text:
        return None
    ids = [pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)]
    spans = []
    for own, table in zip(ids, (pair.a_bytes, pair.b_bytes)):
        if b"".join(table[i] for i in own) != raw:
            return None
        ends = np.cumsum([len(table[i]) for i in own]).tolist()
        spans.append(list(zip(own, [0, *ends[:-1]], ends)))
    common, groups, links = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}, [], Counter()
    open_a, open_b = [], []
    for end in sorted(common):
        open_a, open_b = ([x for x in side if x[2] <= end and x[1] >= (groups[-1][0] if groups else 0)] for side in spans)
        groups.append((end, ",".join(str(x[0]) for x in open_a) + "|" + ",".join(str(y[0]) for y in open_b)))
        links.update((x[0], y[0]) for x in open_a for y in open_b if x[1] < y[2] and y[1] < x[2])
    return len(ids[0]), len(ids[1]), [g for _, g in groups], links


def test_fragments_compose_in_any_tree(pair):
    r = random.Random(4)
    for text in [awkward(k, 12) for k in range(60)] + [" a", "a ", "  ", "\u2581", "日本語" * 30, "x" * 300, "a <|endoftext|> b"]:
        want = plain_alignment(pair, text)
        for size in (5, 23, 1000):
            parts = [token_alignment.from_row(token_alignment.to_row(0, 0, token_alignment.fragment_of(pair, *c))) for c in token_alignment.chunks(text, size)]
            while len(parts) > 1:
                k, n = r.randrange(len(parts) - 1), r.randint(2, 4)
                parts[k:k + n] = [token_alignment.compose(pair, parts[k:k + n])]
            x = parts[0]
            got = (x.n_a, x.n_b, b";".join(x.written).decode().split(";"), Counter({(k >> 32, k & 0xFFFFFFFF): n for k, n in x.links.items()})) if x.valid else None
            assert got == want, (size, text)


def test_both_libraries_give_the_same_tokens(pair):
    quick = token_alignment.pair_of(open(A, "rb").read(), open(B, "rb").read(), public_tokenizers.PATTERN)
    r = random.Random(1)
    letters = [chr(c) for c in range(ord(token_alignment.SETTLED))] + ["'s", "'LL", " the", "<|endoftext|>", "  ", "12"]
    for text in ["".join(r.choice(letters) for _ in range(200)) for _ in range(200)] + [awkward(k, 300).encode("latin-1", "ignore").decode("latin-1") for k in range(20)]:
        assert max(text) < token_alignment.SETTLED
        assert quick.quick.encode_ordinary(" " + text) == pair.a.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [token_alignment.CHUNK, 50])
def test_alignment_against_brute_force(spark, pair, chunk):
    prepare(spark)
    rows = [(i, t) for i, t in ROWS if len(t or "") < 3000] + [(90, "\u2581 x"), (91, "x" * 900), (92, "日本語 テキスト " * 40), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("batch", "doc", "kind", "n")}).repartition(3)
    found = [plain_alignment(pair, t) for _, t in rows]
    total, best = Counter(), Counter()
    for x in found:
        total.update(x[3] if x else {})
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    want = []
    for (i, _), x in zip(rows, found):
        if x is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        want.append((i, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if total[p] == best[p[1]]),
                     sum(n * total[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    out = token_alignment.align(docs, A, B, public_tokenizers.PATTERN, chunk=chunk)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    if chunk == 50:
        assert token_alignment.align(docs.limit(0), A, B).count() == 0


# ------------------------------------------------------------------ ranked search

def plain_search(docs, items, top):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(k, i, Counter(words(t))) for k, (i, t) in enumerate(docs)]
    bags = [(k, i, b, sum(b.values())) for k, i, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, _, b, _ in bags for t in b)
    out = []
    for i, t in items:
        scores = []
        for k, doc_id, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1)))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in set(words(t)) if w in bag)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, k, doc_id))
        out += [(i, rank, s[4], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("size,block", [(16_384, 200_000), (7, 5)])
def test_ranked_search_against_brute_force(spark, size, block):
    prepare(spark)
    r = random.Random(8)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 3))) for _ in range(60)] + ["THE", "the"] * 20
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, prose(r.randint(1, 60))) for k in range(150)] + [(7, None), (8, ""), (9, "..."), (None, prose(20)), (3, prose(9)), (500, prose(4000))]
    docs += [(200 + k, docs[0][1]) for k in range(20)]
    items = [(k, prose(r.randint(1, 9))) for k in range(12)] + [(0, "the"), (None, prose(4)), (30, None), (31, "?"), (32, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("doc", "term", "n", "score")}).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(0) for c in ("item", "term", "n")})
    got = sorted(map(tuple, ranked_search.search(df, bench, 10, size, block).collect()), key=repr)
    assert got == sorted(plain_search(docs, items, 10), key=repr)
    if size == 7:
        assert ranked_search.search(df.limit(0), bench).count() == 0 and ranked_search.search(df, bench.limit(0)).count() == 0


def test_intervals_resolve_exactly():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n, top, score, lists = int(rng.integers(1, 60)), int(rng.integers(1, 8)), None, []
        score = np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 6))):
            m = int(rng.integers(1, n + 1))
            places, gain = rng.permutation(n)[:m].astype(np.int32), np.sort(rng.integers(1, rng.integers(2, 200), m))[::-1]
            lists.append((places, gain))
            score[places] += gain
        found = np.flatnonzero(score)
        want = found[np.lexsort((found, -score[found]))][:top]
        places, scores = ranked_search.best(lists, n, top)
        assert places.tolist() == want.tolist() and scores.tolist() == score[want].tolist()


# ------------------------------------------------------------------ personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return out


def spoiled(seed):
    r = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "é@x.org", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "12  34",
             "+1 (555) 123-4567", "+49.", "+1 2", "+123456789012345", "+1234567890123456", "🙂", "..", "+", "@", " ", "\n", "word", "Ünï"]
    return "".join(r.choice(parts) + r.choice(["", " ", " ", ",", "\n"]) for _ in range(r.randint(0, 30)))


def test_base_spans_against_plain_patterns(spark):
    prepare(spark)
    rows = [(k, spoiled(k)) for k in range(150)] + [(1, None), (2, ""), (None, "a@b.c"), (3, "9" * 100_000), (4, "a" * 100_000), (5, "1.2.3.4 " * 3000), (6, "+1" + "." * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("row", "kind", "start", "k", "m")}).repartition(4)
    got = personal_data.report(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    want = []
    for i, t in rows:
        base = plain_base(t)
        want.append((i, *[sum(s.startswith(kind + ":") for s in base) for kind in PLAIN], hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert personal_data.report(df.limit(0)).count() == 0


def test_terms_that_disclose(spark):
    prepare(spark)
    filler = [f"some other words number {k} about the weather and the house" for k in range(60)]
    rows = [(k, t) for k, t in enumerate(filler)]
    rows += [(100, "please write to Zorblatt at z@x.org about the weather"), (101, "the office of Zorblatt is z@x.org and the house"), (102, "call Quux at q@x.org today"),
             (103, "call Quux at q@x.org today"), (104, "Zorblatt has a long name")]
    out = {r.doc_id: r for r in personal_data.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans.split(",")[1:] == [f"generalised:{rows[60][1].index('Zorblatt')}:{rows[60][1].index('Zorblatt') + 8}"] or "removed" in out[100].spans
    assert out[100].n_added == out[101].n_added == 1 and out[100].n_email == 1
    assert out[102].n_added == 0  # one context, delivered twice, is no support
    assert out[104].spans == "" and all(out[k].spans == "" for k in range(60))


def test_sanitised_text(spark):
    prepare(spark)
    rows = [(1, "mail a@b.c or é+1 555 123 4567 now", 5), (2, None, 6), (None, "clean", 7), (3, "x" * 9000 + " 1.2.3.4 " + "é" * 9000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blocks int")
    got = sorted(map(tuple, personal_data.sanitise(df).collect()), key=repr)
    assert got == sorted([(1, "mail <email> or é<phone> now", 5), (2, None, 6), (None, "clean", 7), (3, "x" * 9000 + " <ip> " + "é" * 9000, 8)], key=repr)
