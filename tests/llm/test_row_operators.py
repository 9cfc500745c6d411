"""Quality ledger, decontamination, URL rules, WARC and HTML extraction."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeforge.llm import decontaminate, html_graph, labelled_pages, quality_ledger, url_rules, warc
from lakeforge.llm.common import prepare

from ..helpers import scratch
from .texts import ROWS, awkward

CLASHING = {"n_words": "x", "row": 1, "spans": None, "failed_bits": "y", "kept": "z", "short": 0, "digest": 0, "host": 0}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items() if k not in df.columns})


# ------------------------------------------------------------------ quality

def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), lines, len(re.findall(r"#|\.\.\.|…", text))


def test_measurements():
    texts = [t or "" for _, t in ROWS] + ["a b c a b c", "a a a a", "a a a", "x\nx\n\nx \n", "a b " * 50, "é " * 70, "# $ %" * 9]
    for text in texts:
        assert quality_ledger.measure(text.encode()) == plain_measure(text), text[:60]


def test_ledger_policies_and_ablation(spark):
    prepare(spark)
    rows = ROWS + [(30, " ".join(f"word{k}" for k in range(80))), (31, " ".join(f"w{k}###" for k in range(80))), (32, "say it " * 60), (33, "line of text\n" * 40)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    book = quality_ledger.apply_policy(quality_ledger.ledger(docs))
    got = {(r.doc_id, r.n_words, r.failed_bits, r.kept) for r in book.collect()}
    names = list(quality_ledger.RULES)
    want = set()
    for i, t in rows:
        n, chars, symbols, dup, again, lines, marks = plain_measure(t or "")
        failed = [n < 50, 100 * again > 50 * n, symbols > n, chars < 2 * n, chars > 20 * n, 10 * dup > 6 * lines, n > 1_000_000, 10 * marks > n]
        bits = sum(1 << k for k, f in enumerate(failed) if f)
        want.add((i, n, bits, not any(f for k, f in enumerate(failed) if names[k] in quality_ledger.POLICIES["v1"])))
    assert got == want and book.count() == len(rows)
    kept = quality_ledger.filter_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in book.where("kept").collect())
    rejected = {r.rule: (r.fails, r.rejected_by_it_alone) for r in quality_ledger.ablation(book).collect()}
    ledger = [r.failed_bits & quality_ledger.mask("v1") for r in book.collect()]
    for rule, found in rejected.items():
        b = quality_ledger.bit(rule)
        assert found == (sum(bool(x & b) for x in ledger), sum(x == b for x in ledger))
    assert quality_ledger.ledger(docs.limit(0)).count() == 0
    assert quality_ledger.ablation(quality_ledger.ledger(docs.limit(0))).count() == len(quality_ledger.POLICIES["v1"])


# ------------------------------------------------------------------ decontamination

def plain_report(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).update([str(item)] if item is not None else [])
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def contaminated_rows():
    r = random.Random(5)
    item = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) for n in (13, 14, 30, 5, 1, 20)]
    items = list(enumerate(item)) + [(9, item[2]), (9, item[2]), (None, item[0]), (10, None), (11, "!?"), (100, "Ünique WORD é"), (2, "A" + item[1])]
    docs = list(ROWS[:8]) + [(40, item[0]), (41, item[2].upper()), (42, "x " * 400 + item[1]), (43, ", ".join(item[5].split())), (44, " ".join(item[2].split()[3:16])),
                             (45, " ".join(item[2].split()[3:15])), (46, "so ünique word É"), (46, "so Ünique word é"), (47, item[2] + " " + item[2] + " zz " + item[5])]
    return docs, items


@pytest.mark.parametrize("block", [500_000, 7, 1])
def test_contamination_report(spark, block):
    prepare(spark)
    docs, items = contaminated_rows()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.report(df, bench, block_windows=block).collect()), key=repr)
    assert got == plain_report(docs, items)


def test_contamination_decisions(spark):
    prepare(spark)
    docs, items = contaminated_rows()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [r[0] for r in plain_report(docs, items) if not r[5]]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = decontaminate.cut_spans(spark.createDataFrame([(1, "Keep this, " + items[0][1] + " and that!")], "doc_id long, text string"), bench.where("item_id = 0"))
    assert cut.first().text == "Keep this,  and that!"
    assert decontaminate.report(df, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.report(df.limit(0), bench).count() == 0


# ------------------------------------------------------------------ urls

URLS = [(0, None), (1, ""), (2, "no scheme"), (3, "http://A.Example.NET/en/x?y#z"), (4, "https://example.net"), (5, "http://x.net/"), (6, "http://example.com/de/"), (7, "http://my-example.com/de/a"),
        (8, "ftp://org/fr/1"), (9, "x://org.net/fr/1?u=http://a.org/fr/"), (10, "http://a..net//en/"), (10, "http://a..net//en/"), (None, "http://net/q"), (11, "http://h.org/" + "fr/" * 20_000),
        (12, "http://" + "a." * 5_000 + "example.net/en/" + "b" * 50_000), (13, "://net/"), (14, "http://EXAMPLE.NET/EN/"), (15, "http://é.net/en/\nx"), (16, "http://x.net:80/"), (17, "http://example.net/english/")]
MORE_RULES = url_rules.RULES + [("example.net", "/engl", "allow"), ("net", "/", "block"), ("", "/zz", "block"), (None, "/", "block"), ("x.net", "/a", "allow"), ("org", "", "block")]


def plain_judge(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [url_rules.RULES, MORE_RULES])
def test_url_verdicts(spark, rules):
    pages = clashing(spark.createDataFrame(URLS, "page_id long, url string")).withColumn("path", F.lit(1)).withColumn("rule", F.lit(1)).repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    verdicts = url_rules.judge(pages, table)
    got = sorted(map(tuple, verdicts.collect()), key=repr)
    assert got == sorted([(i, *plain_judge(u, rules)) for i, u in URLS], key=repr)
    assert "Python" not in verdicts._jdf.queryExecution().executedPlan().toString()
    kept = url_rules.filter_pages(pages, table)
    assert kept.columns == pages.columns
    assert sorted((r.page_id for r in kept.collect()), key=repr) == sorted((i for i, u in URLS if plain_judge(u, rules)[3] == "allow"), key=repr)
    assert {r.verdict for r in url_rules.judge(pages, table.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), table).count() == 0


# ------------------------------------------------------------------ warc

def test_warc_round_trip(spark):
    prepare(spark)
    pages = [(0, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (7, "http://c\r\nX: y", "other\x00\r\n\r\nWARC/1.1"), (8, "u", None), (9, "u", ""), (None, "n", "lone"), (None, "n", "same"),
             (11, "u", "z" * 300_000 + awkward(3, 500)), (12, "u", "twice"), (12, "u", "twice"), (13, "é", "é" * 9)] + [(100 + k, f"http://{k}", f"page {k % 37}") for k in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("top", F.lit(2)).repartition(4)
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        body, best = (h or "").encode(), top.get(h or "")
        again = best is not None and i != best
        want.append((i, len(body), warc.base32_of_hex(hashlib.sha1(body).hexdigest()), "revisit" if again else "response", best if again else None))
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == sorted(want, key=repr)
    path = scratch() + "/archives"
    warc.write_archives(df, path, least_bytes=10, records_per_file=9)
    back = warc.read_archives(spark, path, with_payload=True)
    small = [r for r in back.collect() if r.payload_bytes < 10]
    assert back.count() == len(pages) and {r.record_type for r in small} == {"response"}
    assert sorted(bytes(r.payload) for r in small) == sorted((h or "").encode() for _, _, h in pages if len((h or "").encode()) < 10)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    digest = warc.base32_of_hex(hashlib.sha1(b"body").hexdigest())
    good = warc.record(1, "http://a", b"body", digest, None, False)
    archive = good + warc.EMPTY_MEMBER + warc.record(2, "http://b", b"body", digest, 1, True) + warc.EMPTY_MEMBER
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.records(archive)] == [(1, "response", None), (2, "revisit", 1)]
    with pytest.raises(ValueError):
        list(warc.records(warc.record(1, "u", b"bodi", digest, None, False)))
    with pytest.raises(ValueError):
        list(warc.records(good[:-9]))
    plain = zlib.decompress(good, 31).replace(b"Content-Length: 4\r\n\r\nbody", b"Content-Length: 4\r\n\r\nbod")
    packer = zlib.compressobj(wbits=31)
    with pytest.raises(ValueError):
        list(warc.records(packer.compress(plain) + packer.flush()))


# ------------------------------------------------------------------ html

@pytest.fixture(scope="module")
def model(spark):
    prepare(spark)
    return html_graph.train(spark)


def test_extraction_on_held_out_labelled_pages(model):
    right = total = 0
    for seed in range(10**6, 10**6 + 150):
        tree = html_graph.parse(labelled_pages.page(seed))
        belief, _, _ = model.beliefs(tree, html_graph.described(tree), model.pairs())
        for k, tag in enumerate(tree.tag):
            if not tag and tree.text[k].strip():
                total += 1
                right += (belief[k][0] > belief[k][1]) == (tree.truth[k] == 0)
    assert right / total > 0.98


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small page."""
    import itertools
    import math

    tree = html_graph.parse("<div class='menu'>a</div><p>Some text.<b>x</b></p>")
    features, pairs = html_graph.described(tree), model.pairs()
    belief = model.beliefs(tree, features, pairs)[0]
    n = len(tree.tag)
    total, sums = 0.0, [[0.0] * 3 for _ in range(n)]
    for ys in itertools.product(range(3), repeat=n):
        if any(y == 2 and not tree.tag[k] for k, y in enumerate(ys)):
            continue
        weight = math.exp(sum(model.weights.get(f, [0, 0, 0])[ys[k]] for k in range(n) for f in features[k] or ()))
        for k in range(1, n):
            weight *= pairs[html_graph.kind(tree.tag[k])][ys[tree.parent[k]]][ys[k]]
        total += weight
        for k, y in enumerate(ys):
            sums[k][y] += weight
    for k in range(n):
        assert [s / total for s in sums[k]] == pytest.approx(belief[k], abs=1e-6)


def test_extraction_on_awkward_pages(spark, model):
    prepare(spark)
    article = "<article><h1>A  title</h1><p>First\n paragraph &amp; more.<br>Same block.<p><b>Second one, left open.<p>Enoipa.</p></article>"
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>Home</a><li><a>News</a></ul></nav><div class=\"ad\">Buy this now.</div>{article}<footer>&copy; someone and more</footer>"
    want = "A title\n\nFirst paragraph & more. Same block.\n\nSecond one, left open.\n\nEnoipa."
    rows = [(0, "u", None), (1, None, ""), (2, "u", page), (2, "u", page), (3, "u", "<div>" * 50_000 + "deep"), (4, "u", "<p a='" * 2000), (None, "u", "</p></div><"), (5, "u", "<!-- x"), (6, "u", "<script>var a='<p>'</script>"),
            (7, "u", page.replace("Enoipa.", "Long text here. " * 20_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("x")).repartition(2)
    out = html_graph.extract_pages(df, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    got = out.collect()
    assert [r.text for r in got if r.page_id == 2] == [want, want]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (0, 1, 5, 6))
    assert next(r.n_chars for r in got if r.page_id == 7) > 300_000
    assert html_graph.extract_pages(df.limit(0), model).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<p>Only one paragraph here, quite long enough to be the article.</p>", "Only one paragraph here, quite long enough to be the article."),
    ("<body><div>plain text without any wrapper. Another sentence.</div></body>", "plain text without any wrapper. Another sentence."),
    ("<ul><li>First thing<li>Second thing</ul>", "First thing\n\nSecond thing"),
    ("<table><tr><td>One<td>Two</table>", "One\n\nTwo"),
    ("<nav><a href=/>Home</a></nav><footer>made by nobody</footer>", ""),
    ("<ul><li><a href=/x>Home</a><li><a href=/y>News</a></ul>", ""),
])
def test_bare_pages(model, page, want):
    assert model.extract(page) == want


def test_clean_tables_lists_and_code_are_kept():
    table = "\n".join(f"| item {k} | price {k * 7} | in stock |" for k in range(30))
    items = "\n".join(f"* the {k}th thing to buy costs ${k}" for k in range(30))
    code = "\n".join(f"if x{k} < y{k} && y{k} > {k}: total = total + x{k} * {k} % 7" for k in range(30))
    for text in (table, items, code):
        n, _, symbols, _, _, _, marks = quality_ledger.measure(text.encode())
        assert n >= 50 and symbols <= n and 10 * marks <= n, text[:40]


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>x</title><body><p>Text one.<p>Text two.", "Text one.|Text two."),
    ("<head><meta charset=x><style>p{}</style>\n<script>1</script><p>Text one.", "Text one."),
    ("<head><title>x</title>Text one.", "Text one."),
    ("<head><template><p>no</template><noscript><p>no</noscript></head><body>Text one.", "Text one."),
    ("<div><svg><path d='1'></div><p>Text one.", "Text one."),
    ("<svg><g><text>no</text><p>Text one.", "Text one."),
    ("<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg><p>Text one.", "Text one."),
    ("<p>Text one.</p><div><object><p>no</p></div><p>Text two.", "Text one.|Text two."),
    ("<div><object>no<object>no</object>no</object>Text one.</div>", "Text one."),
    ("<section><canvas>no</section><div><audio>no</div><div><video><source>no</div>Text one.", "Text one."),
    ("<form><select><option>no<option>no</form><p>Text one.", "Text one."),
    ("<div><select><option>no<input>Text one.</div>", "Text one."),
    ("<div><datalist><option>no</div><div><template><p>no</div>Text one.", "Text one."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.", "Let x=1 hold."),
])
def test_texts_of_pages_with_omitted_end_tags(page, want):
    tree, blocks = html_graph.parse(page), {}
    for k, tag in enumerate(tree.tag):
        if not tag:
            blocks[tree.block[k]] = blocks.get(tree.block[k], "") + tree.text[k]
    assert "|".join(" ".join(t.split()) for t in blocks.values() if t.strip()) == want
