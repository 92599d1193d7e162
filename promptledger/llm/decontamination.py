"""Benchmark decontamination by a prefix-filtered set join (operator 10).

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (a
shorter item is one window).  A document contains a window only if it contains
each of its words, so one word is a sufficient prefix; the rarest by its count
in all documents is taken.  Document words are joined with these anchors, the
anchor's offset gives the only place where the window could start, places
outside the document are dropped (positional and length bounds), and the words
from that place on are compared with the window exactly.

Words are maximal runs of ASCII letters and digits and of all characters from
U+0080 on, with A-Z lower-cased.

Defined results: a null or empty text has no words and no hits; items without
words or id are ignored.  Windows found in several items count for each of
them.  Repeated documents are judged alike, also when an id has several texts.
Empty tables give empty or clean results; other columns are kept by ``clean``
and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.llm.storage import small, without, written

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())  # what WORD leaves out but for A-Z, which become a-z


def words(text: str) -> Column:
    """The matches of ``WORD`` in the lower-cased text, by one pass over its characters and a split at single spaces
    (``regexp_extract_all`` copies the text for every match)."""
    apart = F.split(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " ")
    return F.coalesce(F.array_remove(apart, ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """win (array of words) and the ids of the items that contain it."""
    w = F.col("w")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.slice(w, i, size))
    return (benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words("text").alias("w"))
            .where(F.size(w) > 0).select("item", F.explode(cut).alias("win"))
            .groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")))


def anchored(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """word, offset, win, items: each window under its rarest word; windows with a word that no document has are left out."""
    vocabulary = written(wins.select(F.explode("win").alias("word")).distinct(), "benchmark-words")
    often = written(docs.select(F.explode(words("text")).alias("word")).join(small(vocabulary), "word")
                    .groupBy("word").agg(F.count("*").alias("n")), "benchmark-word-counts")
    spread = wins.select("win", F.posexplode("win").alias("offset", "word")).join(often, "word", "left")
    rarest = spread.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("a")).where("a.n > 0")
    return wins.join(rarest, "win").select("a.word", "a.offset", "win", "items")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, every: bool = True) -> DataFrame:
    """doc_id, key (hash of the text), n_words, n_hit and items (sorted ids of the items with occurring windows).

    Without ``every``, only of the documents that have an anchor in a fitting place.
    """
    wins = written(windows(benchmark, size), "benchmark-windows")
    anchors = written(anchored(wins, docs), "benchmark-anchors")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    place = (keyed.select("doc_id", "key", words("text").alias("w"))
             .select("doc_id", "key", F.size("w").alias("len"), F.posexplode("w").alias("pos", "word"))
             .join(small(anchors), "word").withColumn("start", F.col("pos") - F.col("offset"))
             .where("start >= 0 and start + size(win) <= len").select("doc_id", "key", "start", "win", "items").distinct())
    found = (place.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "win", "items")).alias("c"))
             .withColumnsRenamed({"doc_id": "_id", "key": "_key"}))
    # the words are bound once, as an element: inside the inner function alone, Spark would take them anew for every place
    right = F.get(F.transform(F.array("w"), lambda own: F.filter("c", lambda c: F.slice(own, c["start"] + 1, F.size(c["win"])) == c["win"])), F.lit(0))
    covered = F.flatten(F.transform("c", lambda c: F.sequence(c["start"], c["start"] + F.size(c["win"]) - 1)))
    none = F.array().cast("array<string>")
    return (keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")), "left" if every else "inner")
            .withColumn("w", words("text")).withColumn("c", right)
            .withColumn("n_words", F.size("w").cast("long"))
            .withColumn("n_hit", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long"))
            .withColumn("items", F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda c: c["items"])))), none))
            .select("doc_id", "key", "n_words", "n_hit", "items"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their columns."""
    found = written(hits(docs, benchmark, every=False).select("doc_id", "key", "n_hit"), "benchmark-hits")
    return without(docs, found.where("n_hit > 0"))


def sql() -> str:
    """DuckDB twin of ``judge`` over ``documents`` and ``benchmark``, by comparing every window of words."""
    cut = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '{}')".format(UPPER, LOWER, WORD)
    return f"""
    with i as (select cast(item_id as varchar) item, {cut} w from benchmark where item_id is not null),
    wins as materialized (select item, array_to_string(w[p:p + {WINDOW - 1}], ' ') win, least(len(w), {WINDOW}) n
             from i, lateral (select unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) p) where len(w) > 0),
    d as materialized (select doc_id, {cut} w from documents),
    sizes as (select distinct n from wins),
    pos as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, sizes where len(w) >= n),
    occ as materialized (select doc_id, p, pos.n, item from pos join wins on array_to_string(w[p:p + pos.n - 1], ' ') = win and pos.n = wins.n),
    hit as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from occ) group by doc_id),
    its as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from occ group by doc_id)
    select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
           sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join hit using (doc_id) left join its using (doc_id)"""
