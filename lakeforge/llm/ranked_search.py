"""Ranked lexical search by NRA: impact-sorted lists read in order, score intervals kept per document.

*Index.*  Every document gives its terms with their counts; kept are the terms that some item asks for.  A posting is
(term, document, impact), where the impact is what the term adds to the document's score; it depends on no item, so the
lists of terms are sorted by it, once.  N, L and df count all documents.  Documents are dealt by hash into shards of some
``SHARD`` documents, which are written as one row each: every term's list in order of impact.  So a task holds one shard,
no list is longer than a shard however common its word is, and lost shards are read again.

*Reading.*  For an item, a shard's lists are read from the top in steps: each step reads on, in all lists, as far as the
impacts stay at or above a floor, and the floor falls by a factor of ``STEP``.  What is read raises the lower bounds of
documents.  A term not yet read for a document adds less than the floor, nor more than its list's greatest impact: that
bounds every document from above, and every document not yet met.

* When the ``top``-th best lower bound exceeds what a document not yet met can reach, no document joins any more.
* Documents that cannot reach that bound are dropped; later steps read on for the others alone, down to the end of the
  lists, so membership, ties and final scores are exact.

Each shard gives its own best ``top`` of each item; the best of these, picked by a window that is limited before it is
shuffled, are the result.  Items are broadcast in blocks of at most ``BLOCK`` terms (under 2 MB), one block at a time (an
item of more terms is a block of its own).

A document is told apart by its row, not by its id.

Defined results: null texts have no term, neither has a text without letters or digits; documents without a term don't
count for N; items without a term, or without a document that scores above 0, give no row; repeated items each get
their list; repeated documents are each ranked, equal scores by ascending id (null last), equal ids in any order; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema

#: Documents per item; documents of a shard; factor by which a step's floor falls; terms of a block of items.
TOP, SHARD, STEP, BLOCK = 50, 4_096, 4, 200_000
#: Maximal runs of digits, a-z and characters from U+0080 on, after A-Z is lower-cased, on UTF-8 bytes.
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rows of an Arrow batch of terms.
ROWS = 100_000
#: What the term of a document's own row begins with: no term does.
OWN = b"\0"


def term_counts(rows: DataFrame, keep: list[str], key: str) -> DataFrame:
    """The columns ``keep`` with ``n`` (terms with repeats), a row per distinct ``term`` with its ``tf``, and a row of the
    document's own, whose term is ``OWN`` and its ``key`` (so that no join deals all of those to one task).

    A text without terms gives no row.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    ddl = f"{kinds}, n long, term string, tf long"
    schema = arrow_schema(ddl)

    def emit(batch: pa.RecordBatch, of: list[int], many: list[int], sizes: list[int], terms: list[bytes], tf: list[int]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.array(of, np.int64), many))
        columns = [batch.column(c).take(at) for c in keep] + [pa.array(np.repeat(np.array(sizes, np.int64), many)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, many, sizes, terms, tf = [], [], [], [], []
            for k, (own, text) in enumerate(zip(batch.column(key).to_pylist(), batch.column("text").cast(pa.binary()))):
                words = TERMS.findall((text.as_py() or b"").lower())
                if not words:
                    continue
                counts = Counter(words)
                of.append(k)
                many.append(len(counts) + 1)
                sizes.append(len(words))
                terms.append(OWN + str(own).encode())
                tf.append(0)
                terms.extend(counts)
                tf.extend(counts.values())
                if len(terms) >= ROWS:
                    yield emit(batch, of, many, sizes, terms, tf)
                    of, many, sizes, terms, tf = [], [], [], [], []
            if terms:
                yield emit(batch, of, many, sizes, terms, tf)

    return rows.mapInArrow(run, ddl)


def shards(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(items with the numbers of their ``terms``, shards of the index)."""
    own = F.col("term").startswith(OWN.decode())
    asked = items.select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    asked = scratch.keep("asked", term_counts(asked, ["item", "item_id"], "item").where(~own).select("item", "item_id", "term"))
    wanted = scratch.keep("wanted", asked.select(F.col("term").alias("wanted")).distinct())
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("doc"))
    counts = term_counts(rows, ["doc", "doc_id"], "doc").join(wanted, F.col("term") == F.col("wanted"), "left")
    counts = scratch.keep("counts", counts.where(F.col("wanted").isNotNull() | own).drop("wanted"))
    n_docs, length = counts.where(own).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = counts.where(~own).groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df")).select("t", weight.alias("w")).where("w > 0")
    weights = scratch.keep("weights", weights.withColumn("number", F.monotonically_increasing_id()))
    share = f"((1000000000L * tf) div (1000L * tf + 20L * (100 - 50 + ((50L * n * {n_docs}L) div {max(1, length)}L))))"
    posted = counts.where(~own).join(weights, F.col("term") == F.col("t")).select("doc", "doc_id", "number", F.expr(f"w * {share}").alias("impact")).where("impact > 0")
    many = max(1, -(-n_docs // size))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"docs array<long>, doc_ids array<{kind}>, numbers binary, begins binary, places binary, impacts binary"
    schema = arrow_schema(ddl)

    def build(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table.select(["doc_id", "doc"]), sort_keys=[("doc_id", "ascending"), ("doc", "ascending")], null_placement="at_end")
        doc = table.column("doc").take(order).to_numpy()
        first = np.concatenate(([True], doc[1:] != doc[:-1]))
        place = np.empty(len(doc), np.int64)
        place[order.to_numpy()] = np.cumsum(first) - 1
        number, gain = table.column("number").to_numpy(), table.column("impact").to_numpy()
        by = np.lexsort((-gain, number))
        numbers, begins = np.unique(number[by], return_index=True)
        one = order.filter(pa.array(first))
        return pa.Table.from_pylist([{"docs": doc[first].tolist(), "doc_ids": table.column("doc_id").take(one).to_pylist(), "numbers": numbers.astype("<i8").tobytes(),
                                      "begins": np.append(begins, len(by)).astype("<i8").tobytes(), "places": place[by].astype("<i4").tobytes(),
                                      "impacts": gain[by].astype("<i8").tobytes()}], schema=schema)

    built = posted.groupBy(F.pmod(F.xxhash64("doc"), F.lit(many)).alias("shard")).applyInArrow(build, ddl)
    built = scratch.keep("shards", built)
    scratch.drop("counts")
    numbered = asked.join(weights, F.col("term") == F.col("t")).groupBy("item").agg(F.max("item_id").alias("item_id"), F.sort_array(F.collect_list("number")).alias("terms"))
    return scratch.keep("items", numbered), built


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``top`` documents over impact-sorted lists of (places, impacts), equal scores by place."""
    lower, seen = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int32)
    most = np.array([impacts[0] for _, impacts in lists], np.int64)
    at, among, floor = [0] * len(lists), None, int(most.max())
    while True:
        floor = floor // STEP if floor >= STEP else 0
        for k, (places, impacts) in enumerate(lists):
            if at[k] == len(impacts) or impacts[at[k]] < floor:
                continue
            to = int(np.searchsorted(-impacts, -floor, "right"))
            new, gain = places[at[k]:to], impacts[at[k]:to]
            if among is not None:
                own = among[new]
                new, gain = new[own], gain[own]
            lower[new] += gain
            seen[new] += 1
            at[k] = to
        if not floor:
            break
        rest = int(np.minimum(most, floor - 1).sum())
        if n_docs > top and among is None:
            last = int(np.partition(lower, n_docs - top)[n_docs - top])
            if last <= rest:
                continue  # a document not yet met may still belong
        elif among is not None:
            last = int(np.partition(lower[among], -top)[-top])
        else:
            continue
        among = (lower + rest - seen * np.int64(floor - 1) >= last) & ((lower > 0) if among is None else among)
    found = np.flatnonzero(lower > 0 if among is None else among & (lower > 0))
    order = np.lexsort((found, -lower[found]))[:top]
    return found[order], lower[found][order]


def blocks(items: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items with their term numbers, in blocks of at most ``most`` terms."""
    block, held = [], 0
    for row in items.select("item", "terms").toLocalIterator():
        if block and held + len(row.terms) > most:
            yield block
            block, held = [], 0
        block.append((row.item, np.array(row.terms, np.int64)))
        held += len(row.terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, size: int = SHARD, block_terms: int = BLOCK) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    asked, index = shards(docs, items, scratch, size)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"item long, doc long, doc_id {kind}, score long"
    schema = arrow_schema(ddl)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    found = None
    for k, block in enumerate(blocks(asked, block_terms)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    numbers, begins, impacts = (np.frombuffer(batch.column(c)[row].as_py(), "<i8") for c in ("numbers", "begins", "impacts"))
                    places = np.frombuffer(batch.column("places")[row].as_py(), "<i4")
                    doc, doc_id = batch.column("docs")[row].values, batch.column("doc_ids")[row].values
                    for item, terms in shared.value:
                        own = np.searchsorted(numbers, terms)
                        own = own[numbers[np.minimum(own, len(numbers) - 1)] == terms]
                        if not len(own):
                            continue
                        at, scores = best([(places[begins[t]:begins[t + 1]], impacts[begins[t]:begins[t + 1]]) for t in own], len(doc), top)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item)), doc.take(pa.array(at)), doc_id.take(pa.array(at)).cast(schema.field("doc_id").type),
                                                          pa.array(scores)], schema=schema)

        ranked = index.mapInArrow(run, ddl).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = scratch.keep(f"ranked{k}", ranked)
        found = ranked if found is None else found.unionByName(ranked)
        shared.unpersist()
    names = asked.select("item", "item_id")
    if found is None:
        found = spark.createDataFrame([], f"{ddl}, rank int")
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, row_number() OVER () AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
size AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS length FROM d WHERE len(words) > 0),
asked AS (SELECT DISTINCT item, item_id, unnest(words) AS term FROM b),
counts AS (
  SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), size),
impacts AS (
  SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))) AS impact
  FROM counts JOIN weights USING (term), size),
scores AS (
  SELECT item, item_id, doc, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) AS rank FROM scores) WHERE rank <= 50
"""
