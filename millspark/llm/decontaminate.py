"""Benchmark passages in training documents, found through a positional inverted index (DataFrame functions only).

The index keeps, for the terms that a search starts from, a posting per occurrence: term, document, place, and the terms
around it. A benchmark window is looked up from its rarest term; the lists of its other terms are intersected in rising
order of frequency, each shifted by its offset in the window, by comparing the terms that stand at those places beside
the posting. What agrees everywhere is a phrase match. With ``slop`` a window also matches nearby when enough of its
terms stand within the window stretched by ``slop`` places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.llm.common import NULL_ID, picked, sized
from millspark.session import staged

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_TERMS = 200_000


def _folded(term: Column) -> Column:
    """A-Z lower-cased; the slower exact mapping only where a term changes at all."""
    return F.when(F.lower(term) == term, term).otherwise(F.translate(term, UPPER, LOWER))


def raw_terms(text: Column) -> Column:
    """Terms of a text before folding; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda t: t != "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (``terms``) of the items, with ``item_ids``; an item shorter than a window is one window."""
    items = picked(items, item_id="string", text="string")
    items = items.select(F.coalesce("item_id", F.lit("null")).alias("item_id"), F.transform(raw_terms(F.col("text")), _folded).alias("all")).filter(F.size("all") > 0)
    size = F.least(F.size("all"), F.lit(window))
    starts = items.select("item_id", "all", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("all") - size + 1)).alias("start"))
    return starts.select("item_id", F.slice("all", F.col("start"), F.col("size")).alias("terms")).groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))


def plan_windows(windows: DataFrame, documents: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Adds each window's ``lookups``: (frequency, term, offset), rarest in the documents first, and its rarest ``term``."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    tokens = documents.select(F.explode(raw_terms(F.col("text"))).alias("term")).select(_folded(F.col("term")).alias("term"))
    counts = tokens.join(sized(terms, broadcast_terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    places = windows.withColumn("id", F.xxhash64("terms")).select("id", "terms", "item_ids", F.posexplode("terms").alias("offset", "term"))
    places = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    planned = places.groupBy("terms").agg(F.first("item_ids").alias("item_ids"), F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("lookups"))
    return planned.filter(F.col("lookups")[0]["n"] > 0).withColumn("term", F.col("lookups")[0]["term"])


def postings(documents: DataFrame, terms: DataFrame, around: int, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """The stored index: ``term, _id, _text, place, first, near`` for each occurrence of ``terms``.

    ``near`` holds the folded terms from place ``first`` on, ``around`` on each side at most.
    """
    tokens = documents.select("_id", "_text", raw_terms(F.col("text")).alias("all")).select("_id", "_text", "all", F.posexplode("all").alias("place", "term"))
    tokens = tokens.withColumn("term", _folded(F.col("term"))).join(sized(terms, broadcast_terms), "term")
    first = F.greatest(F.col("place") - around, F.lit(0))
    near = F.slice("all", first + 1, F.col("place") - first + 1 + around)
    return tokens.select("term", "_id", "_text", "place", first.alias("first"), F.transform(near, _folded).alias("near"))


def find_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, share: float = 0.8,
                  broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Matches ``_id, _text, start, size, item_ids, kind`` of benchmark windows in documents.

    ``kind`` is 'phrase', or with ``slop`` also 'near': at least ``share`` of the window's different terms, the rarest
    among them, within ``slop`` places around where the window would stand. ``_id`` is the document id (the smallest
    long for null) and ``_text`` the hash of its text.
    """
    documents = picked(documents, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    windows = staged(plan_windows(benchmark_windows(items, window), documents, broadcast_terms))
    index = staged(postings(documents, windows.select("term").distinct(), window - 1 + (slop or 0), broadcast_terms))
    met = index.join(windows, "term")
    size = F.size("terms")
    start = F.col("place") - F.col("lookups")[0]["offset"]
    # Place of the window's start in the stored neighbourhood, from 1.
    met = met.withColumns({"start": start, "size": size, "at": start - F.col("first") + 1})
    fits = (F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.size("near"))

    def agrees(i: int) -> Column:
        look = F.col("lookups")[i]
        return (F.col("size") <= i) | (F.get("near", F.col("at") - 1 + look["offset"]) == look["term"])
    phrase = fits & agrees(1) & agrees(2) & (F.slice("near", F.when(fits, F.col("at")).otherwise(1), F.when(fits, F.col("size")).otherwise(0)) == F.col("terms"))
    columns = ["_id", "_text", "start", "size", "item_ids"]
    found = met.filter(phrase).select(*columns, F.lit("phrase").alias("kind"))
    if slop is not None:
        low = F.greatest(F.col("at") - slop, F.lit(1))
        stretch = F.slice("near", low, F.greatest(F.col("at") + F.col("size") - 1 + slop - low + 1, F.lit(0)))
        enough = F.size(F.array_intersect("terms", stretch)) >= F.ceil(F.size(F.array_distinct("terms")) * share)
        found = found.unionByName(met.filter(enough & ~F.coalesce(phrase, F.lit(False))).select(*columns, F.lit("near").alias("kind")))
    return found


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for each document row.

    Terms are runs without ASCII punctuation, white space and control characters, A-Z lower-cased. ``n_hit`` counts the
    document's terms inside any phrase match; a document is contaminated when these are at least a twentieth of its
    terms. Null and empty texts have no terms and are clean. Rows that repeat a ``doc_id`` are judged each by its own
    text; a null ``doc_id`` stays null. An empty benchmark finds nothing, an empty table gives an empty table. A null
    ``item_id`` is named 'null'.
    """
    hits = find_passages(documents, items, window, broadcast_terms=broadcast_terms).groupBy("_id", "_text", "start").agg(
        F.max("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    before = Window.partitionBy("_id", "_text").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    hits = hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))))
    found = hits.groupBy("_id", "_text").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    docs = picked(documents, doc_id="long", text="string").select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_text"), F.size(raw_terms(F.col("text"))).cast("long").alias("n_words"))
    joined = docs.join(found, ["_id", "_text"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "_text", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM i),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, z WHERE len(w) >= n),
h AS MATERIALIZED (SELECT doc_id, s, x.n, item_id FROM x JOIN i ON i.n = x.n AND i.win = array_to_string(w[s:s + x.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
