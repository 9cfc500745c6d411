"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger holds one row per document: the measurements and one long
whose bit ``k`` says that rule ``k`` failed.  Policies are versioned masks over those bits, so a new policy, or the
question what a rule costs, never reads a text again: both are bitwise operations on the ledger.

Defined results: a null or empty text has no words and no lines with a word, and fails ``few_words``.  Repeated rows
each get their ledger row.  Extra columns are ignored by the ledger and kept by :func:`filter_documents`.  A text of
any length is measured whole.  An empty table gives an empty ledger.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

WORD = rb"[^\x20\x09-\x0D]+"
SYMBOLS = b"#*$%&|<>"

#: Rule name -> failure condition over the measurements.  The position is the rule's bit; append only.
#: Hash signs and ellipses are held to a tenth of the words, the ratio in common published rule sets; the other symbols
#: stand in clean tables, lists, prices and code, and reject only where they outnumber the words.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 6 * n_lines",
    "many_words": "n_words > 1000000",
    "marks": "10 * n_marks > n_words",
}

#: Versioned policies: the rules that reject.  ``base`` is the contract's floor; ``v1`` is the production policy.
#: ``many_words`` is measured only.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_trigrams"),
    "v1": ("few_words", "repeated_trigrams", "symbols", "short_words", "long_words", "duplicate_lines", "marks"),
}

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The failure bits that a policy rejects on."""
    return sum(bit(rule) for rule in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text.  Windows are compared exactly."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k:len(words) - 2 + k] |= again
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    white = int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    chars = int(((raw & 0xC0) != 0x80).sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), chars - white, sum(text.count(SYMBOLS[k:k + 1]) for k in range(len(SYMBOLS))),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), text.count(b"#") + text.count(b"...") + text.count("…".encode()))


def failed_bits() -> Column:
    """The failure bits as one long, each rule evaluated once."""
    bits = F.lit(0).cast("long")
    for rule, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failed_bits``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        found = [measure(t) for t in text_bytes(batch.column("text"))]
        names = re.findall(r"(\w+) long", MEASURES)
        return {"doc_id": batch.column("doc_id")} | {n: [m[k] for m in found] for k, n in enumerate(names)}

    return map_batches(rows, work, f"doc_id {kind}, {MEASURES}").withColumn("failed_bits", failed_bits())


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy costs: documents it fails, and documents that only it rejects.

    One pass over the ledger; each output row is a pair of sums over bit tests.
    """
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = [F.count(F.lit(1)).alias("n_docs")]
    for rule in POLICIES[policy]:
        sums += [F.count(F.when(hit.bitwiseAND(F.lit(bit(rule)).cast("long")) != 0, 1)).alias(f"{rule}:fails"),
                 F.count(F.when(hit == bit(rule), 1)).alias(f"{rule}:alone")]
    total = book.agg(*sums)
    rules = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(r).alias("rule"), F.col("n_docs"),
                               F.col(f"`{r}:fails`").alias("fails"), F.col(f"`{r}:alone`").alias("rejected_by_it_alone"))
                      for r in POLICIES[policy]])
    return total.select(F.inline(rules))


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns, in one pass (the ledger is read off each row)."""
    columns = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    fields = own.schema["row"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        found = [measure(t) for t in text_bytes(batch.column("text"))]
        names = re.findall(r"(\w+) long", MEASURES)
        return {"row": batch.column("row")} | {n: [m[k] for m in found] for k, n in enumerate(names)}

    book = map_batches(own, work, f"row {fields}, {MEASURES}").withColumn("failed_bits", failed_bits())
    return apply_policy(book, policy).where("kept").select("row.*")


#: The production policy in SQL; the bits are in the order of ``RULES``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM w),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '#|\.\.\.|…')) AS n_marks
  FROM d LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_symbols > n_words)::BIGINT
         + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
         + 32 * (10 * n_dup_lines > 6 * n_lines)::BIGINT + 64 * (n_words > 1000000)::BIGINT + 128 * (10 * n_marks > n_words)::BIGINT AS failed_bits
  FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits & 191 = 0 AS kept FROM b
"""


#: What each rule of two policies costs, from the same rows.
ABLATION = "WITH l AS (" + ORACLE + ")" + " UNION ALL ".join(f"""
SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) AS n_docs, count(*) FILTER (failed_bits & {bit(rule)} <> 0) AS fails,
       count(*) FILTER (failed_bits & {mask(policy)} = {bit(rule)}) AS rejected_by_it_alone FROM l""" for policy, rules in POLICIES.items() for rule in rules)
