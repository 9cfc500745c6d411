"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text of a page is a node with a hidden label: *main*, *other*, or *both* (an element that holds
texts of either kind).  A node's features (tag, words of class, id and role, amount of text, share of links) give its
own potential; each parent and child share a potential by the child's kind.  Sum-product messages pass from the leaves
up and from the root down, once each, which on a tree gives every node's exact marginal.  A text whose marginal favours
*main* is kept.

The potentials are learnt in Spark from labelled pages (:mod:`labelled_pages`; ``LABELLED`` of them, the bound of the
training sample) by climbing their likelihood, whose slope is the observed features less those that the marginals
expect.  The model is some hundred numbers and is broadcast; every page is then parsed and decided on its own.

Texts are cut into blocks at block-level elements; white space in a block becomes one space, blocks are joined by an
empty line.  Script, style and other unrendered elements are never text.

Defined results: a null or empty html has the empty text; broken markup is read as a browser would roughly read it
(open elements end where their parent ends, also those that are never text; an open head ends at the first thing that may
not stand in it); very deep or long pages take no recursion; repeated rows each get a row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled_pages
from .common import map_batches, text_values

#: Labelled pages that the model is trained on; the shares they are learnt in, the rounds, and the first step's rate.
LABELLED, SHARES, ROUNDS, RATE = 1200, 4, 3, 0.1
MAIN, OTHER, BOTH = range(3)
#: Marks a labelled stretch of a training page; it is no node of the tree.
LABEL = "x-label"
#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title svg iframe object canvas audio video textarea select datalist".split())
#: Elements that may stand in the head; any other, and any text, ends a head that is left open.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that end an svg that is left open.
ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INLINE = frozenset("math annotation maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of the key ends an open one of the values, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SECTIONS = frozenset("nav header footer aside form article main section".split())
#: Elements whose text is not taken for the main text of a bare page.
NOT_PLAIN = frozenset("a aside button dialog fieldset footer form header input label legend menu nav option select".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_END = tuple(".!?…:;\"”")


@dataclass
class Tree:
    """A page: nodes in document order; a text node has tag ''."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[frozenset[str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)


#: Markup: comments and declarations, tags (quoted attribute values may hold '>'), or a tag that never closes its quote.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe".split())


class Reader:
    """Builds the tree of a page."""

    def __init__(self):
        self.tree, self.open, self.blocks, self.unseen, self.head = Tree(), [], 0, "", False
        self.inner: Counter[str] = Counter()  # elements open within the unseen one
        self.truth = [-1]  # of the labelled stretches that are open
        self.add("html")
        self.open.append(0)

    def add(self, tag: str, tokens: frozenset[str] = frozenset(), text: str = "") -> int:
        t = self.tree
        t.parent.append(self.open[-1] if self.open else -1)
        t.tag.append(tag)
        t.tokens.append(tokens)
        t.text.append(text)
        t.block.append(self.blocks)
        t.truth.append(self.truth[-1])
        return len(t.tag) - 1

    def read(self, html: str) -> Tree:
        at, end = 0, len(html)
        while at < end:
            found = MARKUP.search(html, at)
            if not found:
                self.data(html[at:])
                break
            if found.start() > at:
                self.data(html[at:found.start()])
            at = found.end()
            close, name, said = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if close:
                self.end(name)
                continue
            self.start(name, said)
            if name in RAW:
                closing = re.compile(rf"</{name}\b", re.IGNORECASE).search(html, at)
                at = closing.start() if closing else end
        return self.tree

    def close_to(self, depth: int) -> None:
        if any(self.tree.tag[n] not in INLINE for n in self.open[depth:]):
            self.blocks += 1
        del self.open[depth:]

    def start(self, tag: str, said: str) -> None:
        if self.unseen:
            if not self.ends_unseen(tag):
                if tag not in VOID and not said.endswith("/"):
                    self.inner[tag] += 1
                return
            self.unseen = ""
            if tag == "select":
                return
        if self.head and tag not in HEAD:
            self.head = False
        if tag in ("html", "body") or (self.head and tag != "template"):
            return
        if tag == "head":
            self.head = True
            return
        if tag in UNSEEN:
            if not said.endswith("/"):
                self.unseen, self.inner = tag, Counter()
            return
        given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(said)} if "=" in said else {}
        if tag == LABEL:
            self.truth.append({"1": MAIN, "0": OTHER}[given["data-main"]])
            return
        if tag == "br":
            self.add("", text=" ")
            return
        ends, stops = ({"p"}, {"table", "td", "th", "button"}) if tag in ENDS_P else CLOSES.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1) if ends else ():
            name = self.tree.tag[self.open[depth]]
            if name in ends:
                self.close_to(depth)
                if tag != "tr":
                    break
            elif name in stops or (tag in ENDS_P and name not in INLINE):
                break
        if tag not in INLINE:
            self.blocks += 1
        words = " ".join(v for k, v in given.items() if k != "data-main")
        node = self.add(tag, frozenset(w.lower() for w in TOKEN.findall(words)) if words else frozenset())
        if tag not in VOID:
            self.open.append(node)

    def ends_unseen(self, tag: str) -> bool:
        """Whether the start of an element ends the unseen one, as it does in a browser."""
        if self.unseen == "svg":
            return tag in ENDS_SVG and not (self.inner["foreignobject"] or self.inner["desc"])
        return self.unseen == "select" and tag in ("input", "select", "textarea")

    def depth_of(self, tag: str) -> int:
        """The open element that an end tag closes; 0 if none."""
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tree.tag[self.open[depth]]
            if name == tag:
                return depth
            if tag in INLINE and name not in INLINE:
                break
        return 0

    def end(self, tag: str) -> None:
        if self.unseen:
            if self.inner[tag]:
                self.inner[tag] -= 1
                return
            if tag == self.unseen:
                self.unseen = ""
                return
            if tag not in ("body", "html") and not self.depth_of(tag):
                return
            self.unseen = ""
        if tag in ("head", "body", "html"):
            self.head = False
            return
        if tag == LABEL:
            self.truth.pop()
            return
        depth = self.depth_of(tag)
        if depth:
            self.close_to(depth)

    def data(self, text: str) -> None:
        if not self.unseen:
            self.head = self.head and not text.strip()
            if not self.head:
                self.add("", text=unescape(text))


def parse(html: str) -> Tree:
    return Reader().read(html)


def bucket(n: int) -> int:
    """Powers of two."""
    return min(10, n.bit_length())


def described(tree: Tree) -> list[tuple[str, ...] | None]:
    """The features of each node; None for nodes without any text, which take no part."""
    n = len(tree.tag)
    chars, linked, heads, in_link = [0] * n, [0] * n, [False] * n, [False] * n
    for k, tag in enumerate(tree.tag):
        in_link[k] = tag == "a" or (k > 0 and in_link[tree.parent[k]])
        if not tag:
            chars[k] = len(tree.text[k].strip())
            linked[k] = chars[k] * in_link[k]
        heads[k] = tag == "h1"
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        heads[p] |= heads[k]
    out: list[tuple[str, ...] | None] = []
    for k, tag in enumerate(tree.tag):
        if not chars[k]:
            out.append(None)
        elif tag:
            share = "all" if linked[k] > 0.9 * chars[k] else "most" if linked[k] > chars[k] / 2 else "some" if linked[k] else "no"
            out.append((f"tag {tag}", f"links {share}", f"length {bucket(chars[k])}", f"head {heads[k]}",
                        f"in {tree.tag[tree.parent[k]] if k else ''} {tag} {bool(tree.tokens[k])}", *[f"word {w}" for w in tree.tokens[k]]))
        else:
            text = tree.text[k].strip()
            out.append((f"text {bucket(chars[k])}", f"linked {in_link[k]}", f"ends {text.endswith(SENTENCE_END)}", f"sign {'©' in text}"))
    return out


def kind(tag: str) -> str:
    """The kind of a child, by which it shares a potential with its parent."""
    return "text" if not tag else "section" if tag in SECTIONS else "inline" if tag in INLINE else "block"


def labelled(tree: Tree) -> list[int]:
    """The label of every node of a labelled page, from the texts below it; -1 where there are none."""
    out = [tree.truth[k] if not tree.tag[k] and tree.text[k].strip() else -1 for k in range(len(tree.tag))]
    for k in range(len(out) - 1, 0, -1):
        p = tree.parent[k]
        if out[k] >= 0:
            out[p] = out[k] if out[p] in (-1, out[k]) else BOTH
    return out


KINDS = ("text", "section", "inline", "block")


class Model:
    """Log potentials: three for each feature, and three by three (parent's label, child's) for each kind of child."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = {k: list(v) for k, v in (weights or {}).items()}
        for name in KINDS:
            for above in range(3):
                self.weights.setdefault(f"child {name} {above}", [0.0, 0.0, 0.0])

    def pairs(self) -> dict[str, list[list[float]]]:
        return {name: [[math.exp(max(-30.0, min(30.0, w))) for w in self.weights[f"child {name} {above}"]] for above in range(3)] for name in KINDS}

    def beliefs(self, tree: Tree, features: list[tuple[str, ...] | None], pairs: dict) -> tuple[list, list, list]:
        """(P(label), the message up, the rest of the parent's belief) of every node with text: messages up, then down."""
        n, weights = len(tree.tag), self.weights
        up: list = [None] * n  # a node's own potential times its children's messages
        for k, own in enumerate(features):
            if own is not None:
                a = b = c = 0.0
                for f in own:
                    w = weights.get(f)
                    if w is not None:
                        a, b, c = a + w[0], b + w[1], c + w[2]
                top = max(a, b, c)
                up[k] = [math.exp(max(a - top, -40)), math.exp(max(b - top, -40)), math.exp(max(c - top, -40)) if tree.tag[k] else 0.0]
        sent: list = [None] * n
        for k in range(n - 1, 0, -1):
            if up[k] is None:
                continue
            x, y, z = up[k]
            message = [row[0] * x + row[1] * y + row[2] * z for row in pairs[kind(tree.tag[k])]]
            most = max(message)
            sent[k] = message = [max(m / most, 1e-30) for m in message]
            above = up[tree.parent[k]]
            x, y, z = above[0] * message[0], above[1] * message[1], above[2] * message[2]
            most = max(x, y, z)
            above[0], above[1], above[2] = max(x / most, 1e-250), max(y / most, 1e-250), max(z / most, 1e-250)
        belief: list = [None] * n
        rest: list = [None] * n
        for k in range(n):
            if up[k] is None:
                continue
            if k == 0:
                both = up[0]
            else:  # what the parent knows but from this child
                above, message = belief[tree.parent[k]], sent[k]
                rest[k] = a, b, c = above[0] / message[0], above[1] / message[1], above[2] / message[2]
                pair, own = pairs[kind(tree.tag[k])], up[k]
                both = [own[y] * (a * pair[0][y] + b * pair[1][y] + c * pair[2][y]) for y in range(3)]
            total = sum(both)
            belief[k] = [v / total for v in both] if total > 0 else [1 / 3] * 3
        return belief, up, rest

    def learn(self, tree: Tree, rate: float) -> None:
        """One step up the likelihood of a labelled page: observed less expected features, by the marginals."""
        features, labels, pairs = described(tree), labelled(tree), self.pairs()
        belief, up, rest = self.beliefs(tree, features, pairs)
        for k, y in enumerate(labels):
            if y < 0:
                continue
            step = [rate * ((y == v) - belief[k][v]) for v in range(3)]
            for f in features[k]:
                w = self.weights.setdefault(f, [0.0, 0.0, 0.0])
                w[0], w[1], w[2] = w[0] + step[0], w[1] + step[1], w[2] + step[2]
            if k:
                name = kind(tree.tag[k])
                joint = [[rest[k][a] * pairs[name][a][v] * up[k][v] for v in range(3)] for a in range(3)]
                total = sum(map(sum, joint)) or 1.0
                for a in range(3):
                    w = self.weights[f"child {name} {a}"]
                    for v in range(3):
                        w[v] += rate * ((a == labels[tree.parent[k]] and v == y) - joint[a][v] / total)

    def extract(self, html: str) -> str:
        """The main text of a page."""
        if not html:
            return ""
        tree = parse(html)
        belief = self.beliefs(tree, described(tree), self.pairs())[0]
        blocks: dict[int, list[str]] = {}
        for k, tag in enumerate(tree.tag):
            if not tag and (belief[k] is None or belief[k][MAIN] > belief[k][OTHER]):
                blocks.setdefault(tree.block[k], []).append(tree.text[k])
        if not any(t.strip() for parts in blocks.values() for t in parts):
            blocks = bare(tree)
        return "\n\n".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def bare(tree: Tree) -> dict[int, list[str]]:
    """The blocks of a page in which the model finds no main text: what stands in plain elements only.

    Plain are elements that no class, id or role names and that are neither a link nor a section that tells what it is
    for.  So a page of one paragraph, list or table is that, and a page of menus and footers is still empty.
    """
    plain, blocks = [True] * len(tree.tag), {}
    for k, tag in enumerate(tree.tag):
        named = tag in NOT_PLAIN or bool(tree.tokens[k])
        plain[k] = not named and (k == 0 or plain[tree.parent[k]])
        if not tag and plain[k]:
            blocks.setdefault(tree.block[k], []).append(tree.text[k])
    return blocks


def train(spark: SparkSession, pages: int = LABELLED, first_seed: int = 0) -> Model:
    """Learns the potentials from labelled pages.

    Each of ``SHARES`` shares climbs on its own pages in a task, from the same start; the weights are averaged, ``ROUNDS``
    times over.  What comes back is a row per feature.
    """
    weights: dict[str, list[float]] = {}
    for number in range(ROUNDS):
        rate = RATE / (1 + number)
        shared = spark.sparkContext.broadcast(weights)

        def work(batch: pa.RecordBatch, shared=shared, rate=rate) -> dict:
            model = Model(shared.value)
            for seed in batch.column("id").to_pylist():
                model.learn(parse(labelled_pages.page(seed)), rate)
            return {"name": list(model.weights), "w": list(model.weights.values())}

        seeds = spark.range(first_seed, first_seed + pages, numPartitions=SHARES)
        found = map_batches(seeds, work, "name string, w array<double>").groupBy("name").agg(*[F.sum(F.col("w")[y]).alias(f"w{y}") for y in range(3)])
        weights = {r.name: [round(r[f"w{y}"] / SHARES, 9) for y in range(3)] for r in found.collect()}
    return Model(weights)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or train(spark))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def work(batch: pa.RecordBatch) -> dict:
        own = shared.value
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": [own.extract(h) for h in text_values(batch.column("html"))]}

    out = map_batches(pages.select("page_id", "url", "html"), work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
