"""Personal data: patterns, and information-theoretic sanitisation of what gives it away.  DataFrame functions only.

*Base.*  Four patterns (email, ip, card, phone) find the protected entities of every whole text, leftmost and without
overlaps per kind; a match that fails its check (parts, Luhn, digits) is dropped.  The patterns are written with
possessive loops and a look behind, so that no run of characters is scanned twice; they match what the plain ones do.

*Disclosure.*  A document sanitised of an entity may still name it by a term that stands beside it wherever it occurs.
The corpus tells which: over all documents, with p the share of documents that hold a thing,

    IC(e) = -log2 p(e)        PMI(e, t) = log2(p(e, t) / (p(e) p(t)))        disclosure(e, t) = PMI(e, t) / IC(e)

where (e, t) counts a document if t stands within ``CONTEXT`` characters of e.  Disclosure is 1 if t occurs with e only,
0 if t tells nothing of e.  A term is *removed* from ``REMOVE`` on and *generalised* from ``GENERALISE`` on, if at least
``SUPPORT`` different contexts say so (copies of one passage are one context).  A term is a run of three letters or more,
compared in lower case.  Terms are looked for beside the entity they disclose.

Counting is linear: an entity meets the terms of its own context only.  Terms are counted per document and summed up
before they are shuffled; pairs are grouped by entity, term and document, so an entity that a third of all rows hold is
spread over all tasks.  Positions are running sums over the matches of one text, so no text is shuffled by ``report``.

Defined results: null and empty texts hold nothing; repeated rows each get a row, and count as often as they are there;
ids are not looked at; a span found for two reasons is there once, removed if any says so; extra columns are ignored by
``report`` and kept by ``sanitise``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Kinds in the order of the result, with their patterns.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"\p{L}+"
#: Characters on either side of an entity whose terms may disclose it; letters of a term; different contexts needed.
CONTEXT, LETTERS, SUPPORT = 64, 3, 2
#: Disclosure from which on a term is generalised or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Kinds of added spans, after the base ones.
ADDED = ["generalised", "removed"]
#: Characters of a block when a text is cut.
BLOCK = 4096


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(k: Column) -> Column:
        digit = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        return F.when(k % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def found_in(rows: DataFrame) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end``, ``value``, ``before`` and ``after`` of every entity, and a row with a null
    kind for a text without any match.

    ``rows`` has ``row`` and ``text``; other columns are kept.  ``before`` and ``after`` are the whole words within
    ``CONTEXT`` characters, as far as the next match of the kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in rows.columns if c != "text"]

    def matches(kind: str) -> Column:
        values, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)

        def one(pair: Column, k: Column) -> Column:
            gap, after = pair["gaps"], pair["next"]
            near, far = F.right(gap, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))
            near = F.when(F.length(gap) > CONTEXT, F.regexp_replace(near, rf"^{WORD}", "")).otherwise(near)
            far = F.when(F.length(after) > CONTEXT, F.regexp_replace(far, rf"{WORD}$", "")).otherwise(far)
            return F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("k"), pair["values"].alias("value"), F.length(gap).cast("long").alias("gap"),
                            near.alias("before"), far.alias("after"))

        zipped = F.arrays_zip(values.alias("values"), F.slice(gaps, F.lit(1), F.size(values)).alias("gaps"), F.slice(gaps, F.lit(2), F.size(values)).alias("next"))
        return F.when(text.rlike(PATTERNS[kind]), F.transform(zipped, one))

    none = F.array().cast("array<struct<kind:string,k:bigint,value:string,gap:bigint,before:string,after:string>>")
    every = F.concat(*[F.coalesce(matches(kind), none) for kind in KINDS])
    at = rows.select(*keep, F.explode_outer(every).alias("m")).select(*keep, "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value").cast("long")
    end = F.sum(F.col("gap") + size).over(so_far)
    placed = at.withColumn("end", end).withColumn("start", F.col("end") - size)
    ok = F.coalesce(*[F.when(F.col("kind") == kind, passes(kind, F.col("value"))) for kind in KINDS], F.lit(True))
    return placed.select(*keep, "kind", "start", "end", "value", "before", "after", ok.alias("ok"))


def words_of(context: Column, origin: Column) -> Column:
    """The terms of a context that begins at ``origin``: structs of ``term``, ``start``, ``end``."""
    words, gaps = F.regexp_extract_all(context, F.lit(WORD), F.lit(0)), F.split(context, WORD, -1)

    def sizes(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s + F.length(x))

    def one(word: Column, k: Column) -> Column:
        start = origin + sizes(gaps, k + 1) + sizes(words, k)
        return F.struct(F.lower(word).alias("term"), start.alias("start"), (start + F.length(word)).alias("end"))

    return F.filter(F.transform(words, one), lambda w: F.length(w["term"]) >= LETTERS)


def contexts(entities: DataFrame) -> DataFrame:
    """``row``, ``kind``, ``value``, ``context`` (a digest) and each ``term`` with its place."""
    beside = F.concat(words_of(F.col("before"), F.col("start") - F.length("before")), words_of(F.col("after"), F.col("end")))
    context = F.xxhash64("before", "after")
    return entities.select("row", "kind", "value", context.alias("context"), F.explode(beside).alias("w")).select("row", "kind", "value", "context", "w.*")


def document_counts(rows: DataFrame) -> DataFrame:
    """``term`` and ``n_term``, the documents that hold it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0)))
    return rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(entities: DataFrame, near: DataFrame, rows: DataFrame, n_docs: int) -> DataFrame:
    """``kind``, ``value``, ``term``, ``disclosure`` of the terms that disclose an entity."""
    pairs = near.groupBy("kind", "value", "term").agg(F.count_distinct("row").alias("n_both"), F.count_distinct("context").alias("n_contexts"))
    pairs = pairs.where(F.col("n_contexts") >= SUPPORT)
    held = entities.groupBy("kind", "value").agg(F.count_distinct("row").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    counted = pairs.join(held, ["kind", "value"]).join(document_counts(rows), "term", "left")
    n_term = F.greatest("n_term", "n_both")
    content = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    told = F.when(content > 0, F.round(1 - F.log2(n_term / F.col("n_both")) / content, 9))
    return counted.select("kind", "value", "term", told.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``rows`` but ``text``, with ``kind``, ``start``, ``end`` of every span; a null kind for none."""
    keep = [c for c in rows.columns if c != "text"]
    found = scratch.keep("found", found_in(rows))
    n_docs = found.select(F.count_distinct("row")).first()[0]
    entities = found.where("kind IS NOT NULL AND ok")
    near = scratch.keep("near", contexts(entities))
    told = scratch.keep("told", disclosing(entities, near, rows, n_docs))
    action = F.when(F.max("disclosure") >= REMOVE, "removed").otherwise("generalised")
    added = near.join(told, ["kind", "value", "term"]).groupBy("row", "start", "end").agg(action.alias("kind"))
    base = found.select(*keep, F.when(F.col("ok"), F.col("kind")).alias("kind"), "start", "end")
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep if c != "row"]
    return base.unionByName(added.select("row", *nothing, "kind", "start", "end"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the four kinds and of added spans, ``base_sha256``, and all ``spans`` written out."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    every = spans(rows, Scratch(docs.sparkSession, "personal"))
    names = KINDS + ADDED
    place = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(k)) for k, kind in enumerate(names)])
    listed = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(place.alias("place"), "start", "end", "kind"))))
    one = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), listed.alias("listed"))

    def written(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kinds: list[str]) -> Column:
        return F.size(F.filter("listed", lambda s: s["kind"].isin(kinds))).cast("long")

    base = F.filter("listed", lambda s: s["place"] < len(KINDS))
    return one.select("doc_id", *[n([kind]).alias(f"n_{kind}") for kind in KINDS], n(ADDED).alias("n_added"),
                      F.sha2(written(base), 256).alias("base_sha256"), written(F.col("listed")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns and rows, with every span of ``text_col`` replaced: base kinds and generalised terms by
    their kind in angle brackets, removed terms by nothing.  Of spans that overlap the first keeps its place.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = scratch.keep("rows", docs.select(whole.alias("document"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row")))
    every = spans(rows.select("row", "text"), scratch).where("kind IS NOT NULL")
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = every.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).where("`from` < end")
    label = F.when(F.col("kind") == "removed", "").otherwise(F.concat(F.lit("<"), "kind", F.lit(">")))
    label = F.when(F.col("from") == F.col("start"), label).otherwise("")
    gathered = cut.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "end", label.alias("label")))).alias("cuts"))
    blocks, cuts = F.col("blocks"), F.col("cuts")

    def part(begin: Column, end: Column) -> Column:
        """The characters from ``begin`` to ``end``, out of the blocks that hold them."""
        first = F.floor(begin / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(end > begin, F.substring(some, (begin % BLOCK + 1).cast("int"), (end - begin).cast("int"))).otherwise("")

    def kept(c: Column, k: Column) -> Column:
        since = F.when(k > 0, F.get(cuts, k - 1)["end"]).otherwise(F.lit(0).cast("long"))
        return F.concat(part(since, c["from"]), c["label"])

    rest = part(F.get(cuts, F.size(cuts) - 1)["end"], F.length("text").cast("long"))
    clean = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(cuts, kept), ""), rest))
    split = rows.join(gathered, "row", "left").withColumn("blocks", F.when(cuts.isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    return split.select(*[clean.alias(c) if c == text_col else F.col(f"document.`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
p(kind, place, pattern) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT r, kind, place, regexp_extract_all(t, pattern) AS v, string_split_regex(t, pattern) AS g FROM d, p WHERE regexp_matches(t, pattern)),
u AS (SELECT r, kind, place, unnest(v) AS value, unnest(range(1, len(v) + 1)) AS k, unnest(g[1:len(v)]) AS gap, unnest(g[2:]) AS next FROM m),
s AS (
  SELECT *, sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY k)::BIGINT AS e, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
         CASE WHEN length(gap) > {CONTEXT} THEN regexp_replace(right(gap, {CONTEXT}), '^\p{{L}}+', '') ELSE gap END AS before,
         CASE WHEN length(next) > {CONTEXT} THEN regexp_replace(left(next, {CONTEXT}), '\p{{L}}+$', '') ELSE next END AS after FROM u),
base AS (
  SELECT r, kind, place, value, before, after, e - length(value) AS b, e FROM s WHERE CASE kind
    WHEN 'ip' THEN regexp_matches(value, '^{PART}(\.{PART}){{3}}$')
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN substr(digits, length(digits) - k + 1, 1)::INT
                       ELSE (2 * substr(digits, length(digits) - k + 1, 1)::INT) // 10 + (2 * substr(digits, length(digits) - k + 1, 1)::INT) % 10 END
                       FOR k IN range(1, length(digits) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 ELSE true END),
side AS (
  SELECT r, kind, value, before, after, b - length(before) AS origin, before AS c FROM base UNION ALL
  SELECT r, kind, value, before, after, e, after FROM base),
w AS (
  SELECT r, kind, value, before, after, origin, unnest(regexp_extract_all(c, '\p{{L}}+')) AS word, unnest(range(1, len(regexp_extract_all(c, '\p{{L}}+')) + 1)) AS k,
         string_split_regex(c, '\p{{L}}+') AS gaps, regexp_extract_all(c, '\p{{L}}+') AS words FROM side),
near AS (
  SELECT r, kind, value, before, after, lower(word) AS term, origin + length(array_to_string(gaps[1:k], '')) + length(array_to_string(words[1:k - 1], '')) AS b,
         origin + length(array_to_string(gaps[1:k], '')) + length(array_to_string(words[1:k], '')) AS e FROM w WHERE length(lower(word)) >= {LETTERS}),
n_term AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(t), '\p{{L}}{{{LETTERS},}}')) AS term FROM d) GROUP BY term),
n_entity AS (SELECT kind, value, count(DISTINCT r) AS n_entity FROM base GROUP BY ALL),
n_both AS (SELECT kind, value, term, count(DISTINCT r) AS n_both, count(DISTINCT (before, after)) AS n_contexts FROM near GROUP BY ALL),
content AS (SELECT *, log2((SELECT count(*) FROM d)::DOUBLE / n_entity) AS ic FROM n_entity WHERE n_entity >= {SUPPORT}),
told AS (
  SELECT kind, value, term, round(1 - log2(greatest(n_term, n_both)::DOUBLE / n_both) / ic, 9) AS disclosure
  FROM n_both JOIN content USING (kind, value) LEFT JOIN n_term USING (term) WHERE n_contexts >= {SUPPORT} AND ic > 0),
added AS (
  SELECT r, CASE WHEN max(disclosure) >= {REMOVE} THEN 'removed' ELSE 'generalised' END AS kind, b, e
  FROM near JOIN told USING (kind, value, term) WHERE disclosure >= {GENERALISE} GROUP BY r, b, e),
every AS (
  SELECT r, place, kind, b, e FROM base UNION ALL SELECT r, CASE kind WHEN 'generalised' THEN 4 ELSE 5 END, kind, b, e FROM added),
listed AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
         count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (place > 3) AS n_added,
         string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY place, b, e) FILTER (place < 4) AS base,
         string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY place, b, e) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       coalesce(n_added, 0) AS n_added, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""
