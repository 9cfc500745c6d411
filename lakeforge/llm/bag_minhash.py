"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its shingles of five words (lower-cased A-Z, split at ASCII white space; a shorter text
with words is one shingle).  Two texts are linked if the weighted Jaccard similarity of their multisets, the sum of
the lesser counts over the sum of the greater, is 0.8 or more.

Signature.  A shingle of weight ``w`` owns the points of a Poisson process over time and the weights below ``w``.
The weights are cut at 1, 2, 4, 8 ...: each interval is a process of its own whose rate is its width, and a point of
an interval that the weight only reaches into counts if its weight lies below (thinning), so the points of weight 3
are among those of weight 5.  Each point falls into one of 128 slots; a slot holds the id of its earliest point.  Two
texts agree in a slot with the probability of their weighted Jaccard similarity.  Points are made in order of time, and
a process stops once its next point is later than the latest slot's, so a text costs its shingles plus some 700 points.

Search.  32 bands of 4 slots: a pair at 0.8 shares no band once in 2 * 10^7.  Texts that share a band with others are
candidates; buckets of the same members are one bucket.  First every member meets two *leaders* of each bucket: its most
central member (the one that shares most buckets with most others) and its shortest.  Texts around a common original
all link through it; a text that others merely add to is the shortest.  A bucket whose members are then all in one component
is settled.  In any other bucket, the component that most members are in is its *major* one, and each pair that may still
be a link holds a member of another component, a *stray*.  The buckets of one major component are settled together, so
that a member is handled once and not once a bucket: strays and members are dealt over blocks of some ``BLOCK`` shingles,
and each block of strays meets each block of members.  A meeting compares signatures first, a byte a slot: fewer than
``AGREE`` of 128 agree for a pair at 0.8 once in 3 * 10^9.  Whole texts are fetched only for members that such a pair holds.
Every two texts that share a band end in one class or have been compared.  All links are verified on whole texts; pairs
whose sizes alone rule a link out aren't fetched.

Classes are the connected components of the links.  Identical texts are one text from the start, so copies cost
nothing.  Ids are carried, never used to tell texts apart.

Defined results: identical texts, empty and null ones too, are one class; texts without words have no other links;
repeated rows each get a row; a null id is carried and never names a class unless all ids of the class are null; an
empty table gives an empty result; extra columns are kept by :func:`deduplicated` and ignored by :func:`classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, giving_back, text_bytes, text_key

WORDS = 5
SLOTS, ROWS = 128, 4
#: Shingles whose signatures are made at a time.
GROUP = 200_000
#: Shingles of a block of members, and the least slots in which the signatures of a link agree.
BLOCK, AGREE = 400_000, 72
MIX, STEP, BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2127599BF4325C37)
KEY, LEADER = ["t1", "t2"], ["l1", "l2"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """Remembered word hashes of a worker, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        return self.setdefault(word, xxhash.xxh3_64_intdigest(word))


_HASHES = WordHashes()


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as hashes, in order, and how often each occurs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * BASE + h[k:k + len(out)]
    return np.unique(mixed(out + np.uint64(size)), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` point ids for each bag (distinct hashes, weights); bags must not be empty."""
    shingle = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags])
    bag = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    # the processes: one for each interval of weights that a shingle reaches
    chosen, level, low, width = [], 0, 0, 1
    while True:
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        chosen.append((at, np.full(len(at), level), np.full(len(at), low), np.full(len(at), width)))
        low, level = low + width, level + 1
        width = low
    at, level, low, width = (np.concatenate(x) for x in zip(*chosen))
    seed = mixed(shingle[at] + level.astype(np.uint64) * STEP)
    own, top = bag[at], weight[at]
    clock = np.zeros(len(at))
    earliest = np.full(len(bags) * slots, np.inf)
    ids = np.zeros(len(bags) * slots, np.uint64)
    latest = np.full(len(bags), np.inf)
    active, k = np.arange(len(at)), 0
    while len(active):
        k += 1
        point = mixed(seed[active] + np.uint64(k * int(BASE) % 2**64))
        uniform = ((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock[active] -= np.log(uniform) / width[active]
        going = clock[active] <= latest[own[active]]
        active, point = active[going], point[going]
        place = mixed(point + STEP)
        height = low[active] + (((place & np.uint64(0xFFFFFFFF)) * width[active].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        slot = own[active] * slots + ((place >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        won = (height < top[active]) & (clock[active] < earliest[slot])
        slot, time, name = slot[won], clock[active][won], point[won]
        order = np.argsort(-time, kind="stable")  # of equal slots the last one written, the earliest point, stays
        earliest[slot[order]] = time[order]
        ids[slot[order]] = name[order]
        if k < 16 or k % 16 == 0:
            some = np.unique(own[active])
            latest[some] = earliest.reshape(-1, slots)[some].max(axis=1)
    return ids.reshape(-1, slots)


def band_keys(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key of each band of each signature."""
    bands = found.shape[1] // rows
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(found), bands)).copy()
    for k in range(rows):
        keys = mixed(keys * BASE + found[:, k::rows][:, :bands])
    return keys.view(np.int64)


def sketches(texts: DataFrame) -> DataFrame:
    """``t1``, ``t2``, ``size``, ``keys`` (of the bands) and ``sig`` (a byte a slot) of each text with words.

    A text that a task meets again is skipped; the names a task remembers are at most those of the rows it reads.
    """
    schema = "t1 long, t2 long, size long, keys array<long>, sig binary"
    target = arrow_schema(schema)

    def rows(names: list[tuple[int, int]], bags: list) -> pa.RecordBatch:
        found = signatures(bags)
        own = np.array([(*n, int(b[1].sum())) for n, b in zip(names, bags)], np.int64)
        keys, short = band_keys(found), mixed(found).astype(np.uint8)
        return pa.RecordBatch.from_arrays([*[pa.array(own[:, c]) for c in range(3)], pa.array(list(keys), pa.list_(pa.int64())),
                                           pa.array([r.tobytes() for r in short], pa.binary())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            names, bags, size = [], [], 0
            for name, text in zip(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist()), text_bytes(batch.column("text"))):
                if name in seen:
                    continue
                seen.add(name)
                bag = shingles(text)
                if not len(bag[0]):
                    continue
                if bags and (size + len(bag[0]) > GROUP or len(bags) == 1000):
                    yield rows(names, bags)
                    names, bags, size = [], [], 0
                names.append(name)
                bags.append(bag)
                size += len(bag[0])
            if bags:
                yield rows(names, bags)

    return texts.select("t1", "t2", "text").mapInArrow(giving_back(run), schema)


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Weighted Jaccard similarity of 0.8 or more, in whole numbers."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return 5 * common >= 4 * (int(a[1].sum()) + int(b[1].sum()) - common) > 0


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (text, leader) that are similar, from whole texts."""
    first = pairs.join(texts, KEY)
    lead = texts.select(F.col("t1").alias("l1"), F.col("t2").alias("l2"), F.col("text").alias("lead"))
    schema = "t1 long, t2 long, l1 long, l2 long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bag = None, None
        for batch in batches:
            t1, t2, l1, l2 = (batch.column(n).to_pylist() for n in target.names)
            text, lead = batch.column("text"), batch.column("lead")
            links = []
            for k in range(batch.num_rows):
                if held != (l1[k], l2[k]):  # the members of a leader come one after the other
                    held, bag = (l1[k], l2[k]), shingles(lead[k].as_py().encode())
                if similar(shingles(text[k].as_py().encode()), bag):
                    links.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in links], pa.int64()) for c in (t1, t2, l1, l2)], schema=target)

    return first.join(lead, LEADER).select(*KEY, *LEADER, "text", "lead").mapInArrow(giving_back(run), schema)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``t1``, ``t2`` and ``label`` of each linked text: equal labels for texts that links join.

    Every round a node takes the least label around it and then its label's label, so long chains shrink fast.
    """
    node = lambda a, b: F.concat_ws("/", a, b)
    edges = links.select(node("t1", "t2").alias("a"), node("l1", "l2").alias("b"))
    edges = scratch.keep(f"{name}-edges", edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = scratch.keep(f"{name}-0", labels)
    step = 0
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = scratch.keep(f"{name}-{step + 1}", near.join(of, "label").select("node", F.least("label", "next").alias("label"), "was"))
        scratch.drop(f"{name}-{step}")
        step += 1
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            break
    parts = F.split("node", "/")
    return labels.select(parts[0].cast("long").alias("t1"), parts[1].cast("long").alias("t2"), "label")


def leaders(members: DataFrame) -> DataFrame:
    """A row per bucket and leader (its most central and its shortest member), with the leader's size."""
    found = members.groupBy("key").agg(F.max(F.struct("pull", *KEY, "size")).alias("a"), F.min(F.struct("size", *KEY)).alias("b"))
    named = [F.struct(F.col(f"{x}.t1").alias("l1"), F.col(f"{x}.t2").alias("l2"), F.col(f"{x}.size").alias("lead_size")) for x in "ab"]
    return found.select("key", F.inline(F.array_distinct(F.array(*named))))


def fitting(pairs: DataFrame) -> DataFrame:
    """The pairs of a text and another that their sizes alone allow to be similar."""
    return pairs.where("(t1 <> l1 or t2 <> l2) and 5 * least(size, lead_size) >= 4 * greatest(size, lead_size)")


CELL = "major string, i long, j long, stray boolean, both boolean, t1 long, t2 long, size long, own string, sig binary"


def cell_pairs(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each stray of a cell the members that it may be linked to: another component, fitting sizes, like signatures.

    A pair of two strays meets twice, from either side; it counts once.
    """
    n = cell.num_rows
    stray, both = (cell.column(c).to_numpy().astype(bool) for c in ("stray", "both"))
    size = cell.column("size").to_numpy()
    group = np.unique(np.array(cell.column("own").to_pylist(), object), return_inverse=True)[1]
    name = np.stack([cell.column(c).to_numpy() for c in KEY], axis=1)
    place = np.unique(name, axis=0, return_inverse=True)[1].reshape(-1)
    sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    others = np.flatnonzero(~stray)
    for a in np.flatnonzero(stray):
        fit = (group[others] != group[a]) & (5 * np.minimum(size[others], size[a]) >= 4 * np.maximum(size[others], size[a]))
        fit = others[fit & ~(both[others] & (place[others] < place[a]))]
        fit = fit[(sig[fit] == sig[a]).sum(axis=1) >= AGREE]
        if len(fit):
            yield int(a), fit


def promising(cell: pa.Table) -> pa.Table:
    """The rows of a cell that a pair of like signatures holds."""
    taken = np.zeros(cell.num_rows, bool)
    for a, others in cell_pairs(cell):
        taken[a] = True
        taken[others] = True
    return cell.filter(pa.array(taken))


def cell_links(cell: pa.Table) -> pa.Table:
    """Links of a cell that join components, verified on whole texts."""
    names = list(zip(cell.column("t1").to_pylist(), cell.column("t2").to_pylist()))
    size = cell.column("size").to_numpy()
    group = np.unique(np.array(cell.column("own").to_pylist(), object), return_inverse=True)[1]
    bags = [shingles(t) for t in text_bytes(cell.column("text"))]
    owner, weight = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags]), np.concatenate([b[1] for b in bags])
    shingle = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)[1]
    start, own = np.searchsorted(owner, np.arange(len(bags) + 1)), np.zeros(shingle.max() + 1, np.int64)
    links = []
    for a, others in cell_pairs(cell):
        others = others[group[others] != group[a]]
        if not len(others):
            continue
        mine = slice(start[a], start[a + 1])
        own[shingle[mine]] = weight[mine]
        common = np.bincount(owner, weights=np.minimum(own[shingle], weight), minlength=len(bags)).astype(np.int64)
        own[shingle[mine]] = 0
        for b in others[5 * common[others] >= 4 * (size[others] + size[a] - common[others])]:
            if group[a] != group[b]:
                links.append((*names[a], *names[b]))
                group[group == group[b]] = group[a]
    columns = list(zip(*links)) or [[]] * 4
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip([*KEY, *LEADER], columns)})


def strays_met(held: DataFrame, sketched: DataFrame, texts: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The links that leaders have missed, from buckets that hold several components (None: there are none)."""
    own = held.join(labels, KEY, "left").select(*KEY, "size", "keys", F.coalesce("label", F.concat_ws("/", *KEY)).alias("own"))
    own = scratch.keep("own", own)
    placed = own.select(*KEY, "own", F.explode("keys").alias("key"))
    parts = placed.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"))
    mixed_up = parts.groupBy("key").agg(F.max(F.struct("n", "own")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed_up = scratch.keep("mixed", mixed_up.select("key", F.col("most.own").alias("major")))
    if mixed_up.isEmpty():
        return None
    # the members of a major component come from the labels, once each; of a bucket only its strays are looked up
    stray = placed.join(mixed_up, "key").where("own <> major").select("major", *KEY).distinct()
    stray = scratch.keep("strays", stray.join(own.select(*KEY, "size", "own"), KEY).join(sketched.select(*KEY, "sig"), KEY))
    major = mixed_up.select(F.col("major").alias("own")).distinct()
    inner = own.select(*KEY, "size", "own").join(major, "own").join(sketched.select(*KEY, "sig"), KEY)
    inner = inner.select(F.col("own").alias("major"), *KEY, "size", "own", "sig", F.lit(False).alias("both"))
    every = scratch.keep("every", stray.select("major", *KEY, "size", "own", "sig", F.lit(True).alias("both")).unionByName(inner))
    blocks = every.groupBy("major").agg(F.ceil(F.sum(F.when(F.col("both"), F.col("size"))) / BLOCK).alias("strays"), F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    every = scratch.keep("placed", every.join(scratch.keep("blocks", blocks), "major"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("t2", "t1"), n)
    columns = [c.split()[0] for c in CELL.split(", ")]
    first = every.where("both").withColumn("stray", F.lit(True)).withColumn("i", at("strays")).withColumn("j", to("blocks"))
    second = every.withColumn("stray", F.lit(False)).withColumn("j", at("blocks")).withColumn("i", to("strays"))
    cells = first.select(columns).unionByName(second.select(columns)).groupBy("major", "i", "j")
    likely = scratch.keep("likely", cells.applyInArrow(promising, CELL))
    if likely.isEmpty():
        return None
    return likely.join(texts, KEY).groupBy("major", "i", "j").applyInArrow(cell_links, "t1 long, t2 long, l1 long, l2 long")


def linked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``t1``, ``t2`` and ``label``: the component of each linked text.

    ``docs`` has ``t1``, ``t2`` and ``text`` without nulls.
    """
    sketched = scratch.keep("sketches", sketches(docs).dropDuplicates(KEY))
    bands = sketched.select(*KEY, "size", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")).where("n > 1")
    # buckets of the same members are one; what is joined on a bucket is written first: Spark then splits the rows of a large one
    shared = scratch.keep("shared", shared.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"))
    held = bands.join(shared, "key").groupBy(*KEY, "size").agg(F.sum("n").alias("pull"), F.collect_list("key").alias("keys"))
    held = scratch.keep("held", held)
    members = held.select(*KEY, "size", "pull", F.explode("keys").alias("key"))
    # one row of each text that has company; copies go before anything moves
    one = docs.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(1)))).where("k = 1").select(*KEY, "text")
    texts = scratch.keep("texts", one.join(held.select(*KEY), KEY, "left_semi"))
    met = fitting(members.join(scratch.keep("leaders", leaders(members)), "key")).select(*KEY, *LEADER).distinct()
    links = scratch.keep("links", verified(met, texts))
    labels = components(links, scratch, "first")
    missed = strays_met(held, sketched, texts, labels, scratch)
    if missed is not None:
        links = scratch.keep("missed", missed).unionByName(links)
        labels = components(links, scratch, "second")
    labels = scratch.keep("labels", labels)
    scratch.drop("sketches", "shared", "held", "leaders", "texts", "links", "missed", "own", "mixed", "strays", "every", "blocks", "placed", "likely")
    return labels


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    t1, t2 = text_key(body)
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), body.alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id``, ``class_id`` (the least id of its class) and ``class_docs``."""
    scratch = Scratch(docs.sparkSession, "bagminhash")
    rows = _keyed(docs)
    labels = linked(rows, scratch)
    texts = rows.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = texts.join(labels, KEY, "left").withColumn("label", F.coalesce("label", F.concat_ws("/", *KEY)))
    whole = texts.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_docs"))
    named = texts.select(*KEY, "label").join(whole, "label").select(*KEY, "class_id", "class_docs")
    named = scratch.keep("classes", named)
    return rows.select("doc_id", *KEY).join(named, KEY).select("doc_id", "class_id", "class_docs")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The document with the least id of each class, with all its columns."""
    scratch = Scratch(docs.sparkSession, "bagminhash")
    keyed = _keyed(docs)
    labels = linked(keyed, scratch)
    texts = keyed.groupBy(*KEY).agg(F.min("doc_id").alias("first")).join(labels, KEY)
    rank = F.struct(F.col("first").isNull().alias("none"), "first", *KEY)
    best = texts.groupBy("label").agg(F.min(rank).alias("best"))
    lost = texts.join(best, "label").where("t1 <> best.t1 or t2 <> best.t2").select(F.col("t1").alias("x1"), F.col("t2").alias("x2"))
    lost = scratch.keep("lost", lost)
    t1, t2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t1.alias("x1"), t2.alias("x2"))
    first = F.row_number().over(Window.partitionBy("x1", "x2").orderBy(F.col("row.doc_id").asc_nulls_last()))
    return rows.withColumn("k", first).where("k = 1").join(lost, ["x1", "x2"], "left_anti").select("row.*")
