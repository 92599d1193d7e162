"""Personal data: spans by pattern, and terms that disclose them (operator 5).

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone
numbers; their values are the protected entities.  A corpus-wide estimate then
says how strongly a term reveals an entity:

* terms are runs of ``TERM_LETTERS`` or more letters, lower-cased, outside the spans;
* P(e) is the share of documents with a span of the entity, IC(e) = -log2 P(e)
  the information to protect;
* P(e|t) is the share of the documents with the term that have the entity;
  PMI(e;t) = log2 P(e|t) - log2 P(e);
* the disclosed share is PMI / IC = 1 + log2 P(e|t) / IC(e).

From ``REMOVE_AT`` on, the term is removed; from ``GENERALISE_AT`` on, it is
generalised to a placeholder.  Both need ``MIN_CONTEXTS`` different texts with
both, so that one text and its copies prove nothing.  Every occurrence of the
term is touched, near the entity or not, and in documents without it.

All of it is column expressions, joins and sums.  Only entities of
``MIN_CONTEXTS`` texts meet the words of their documents (others have no rule),
and counts are summed before they are shuffled.

Defined results: a null or empty text has no spans (``sanitise`` keeps it as it
is).  Repeated rows get the same spans.  Spans of different kinds may overlap;
``sanitise`` replaces their union once, by the first span's placeholder.  Empty
tables give empty results; other columns are kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.llm.storage import BROADCAST_ROWS, small, written

# The kinds, in order, and their patterns (possessive and guarded
# so that a long run of characters is read once; matches are the same).
KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must contain for its pattern to be tried at all
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}

TERM_LETTERS = 4
TERM = r"\p{L}{%d,}" % TERM_LETTERS
REMOVE_AT, GENERALISE_AT, MIN_CONTEXTS = 0.95, 0.90, 3
SPAN = "struct<start:int,k:int,end:int,value:string>"


def located(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """Array of (start, end, value) of the pattern's matches to keep; code points, end exclusive.

    The pieces between the matches give the positions.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        one = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["value"].alias("value")))
        return F.struct(end.cast("int").alias("at"), F.when(x["value"].isNull() | ~keep(x["value"]), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    return F.aggregate(both, first, step, lambda acc: acc["found"])


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), part(p)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.coalesce(F.array_sort(F.concat(*(F.when(text.rlike(NEEDS[kind]), _spans(text, kind)).otherwise(none) for kind in KINDS[:4]))), none)


def _spans(text: Column, kind: str) -> Column:
    k = F.lit(KINDS.index(kind)).alias("k")
    return F.transform(F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])),
                       lambda s: F.struct(s["start"].alias("start"), k, s["end"].alias("end"), s["value"].alias("value")))


def _count(kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}")


def _outside(text: Column, spans: Column) -> Column:
    """The text with a blank for each span."""
    first = F.struct(F.lit(0).alias("to"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.when(s["start"] < acc["to"], acc["text"]).otherwise(
            F.concat(acc["text"], F.substr(text, acc["to"] + 1, s["start"] - acc["to"]), F.lit(" "))).alias("text"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, step, lambda acc: F.concat(acc["text"], F.substr(text, acc["to"] + 1, F.length(text)))))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans, their different entities, and the different terms outside them."""
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["k"].cast("string"), F.lower(s["value"]))))
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(_outside(F.col("text"), F.col("spans")), F.lit(TERM), F.lit(0))), F.lower))
    return written(rows.select("doc_id", "key", "spans", entities.alias("entities"), terms.alias("terms")), "private-spans")


def disclosing(found: DataFrame) -> DataFrame:
    """entity, term, share, action of the terms that disclose too much."""
    entities = (found.select("key", F.explode("entities").alias("entity")).groupBy("entity", "key").agg(F.count("*").alias("n"))
                .groupBy("entity").agg(F.sum("n").alias("ef"), F.count("*").alias("texts")).where(F.col("texts") >= MIN_CONTEXTS))
    entities = written(entities, "private-entities")
    with_entity = found.where(F.size("entities") > 0).select("key", "terms", F.explode("entities").alias("entity"))
    # copies of a text are one row with their number
    near = with_entity.join(small(entities.select("entity")), "entity").groupBy("entity", "key").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
    pairs = (near.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "term")
             .agg(F.sum("n").alias("co"), F.count("*").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS))
    pairs = written(pairs, "private-terms")
    # words are summed in every task before they meet the terms near entities
    often = (found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
             .join(pairs.select("term").distinct(), "term"))
    information = F.log2(F.lit(float(max(2, found.count()))) / F.col("ef"))
    share = F.when(information > 0, 1 + F.log2(F.least(F.col("co") / F.col("cf"), F.lit(1.0))) / information).otherwise(0.0)
    return (pairs.join(often, "term").join(entities, "entity").withColumn("share", share).where(F.col("share") >= GENERALISE_AT)
            .select("entity", "term", "share", F.when(F.col("share") >= REMOVE_AT, KINDS.index("removed")).otherwise(KINDS.index("generalised")).alias("action")))


def _light(df: DataFrame, items: str) -> DataFrame:
    """Marked for broadcast if its rows and their items, both counted, are few: whole texts are then not dealt out to meet them."""
    n, inside = df.agg(F.count("*"), F.sum(F.size(items))).first()
    return F.broadcast(df) if max(n, inside or 0) <= BROADCAST_ROWS else df


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, key and all spans (base ones and disclosing terms) of every row of ``docs(doc_id, text)``."""
    found = found_in(docs)
    rules = written(disclosing(found).groupBy("term").agg(F.min("action").alias("action")), "private-rules")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key"))
    hits = (found.select("doc_id", "key", F.explode("terms").alias("term")).join(small(rules), "term").groupBy("doc_id", "key")
            .agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("rules")).withColumnsRenamed({"doc_id": "_id", "key": "_key"}))
    hits = _light(written(hits, "private-hits"), "rules")
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(hits, same)
    every = located(F.col("text"), TERM, lambda value: F.map_contains_key("rules", F.lower(value)))
    more = F.transform(every, lambda t: F.struct(t["start"].alias("start"), F.get(F.map_values(F.map_filter("rules", lambda k, _: k == F.lower(t["value"]))), F.lit(0)).alias("k"),
                                                 t["end"].alias("end"), F.lower(t["value"]).alias("value")))
    added = written(texts.select("_id", "_key", more.alias("more")).dropDuplicates(["_id", "_key"]), "private-added")
    none = F.array().cast(f"array<{SPAN}>")
    # a term that overlaps a span is part of it
    own = F.filter(F.coalesce("more", none), lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))
    return (found.select("doc_id", "key", "spans").join(added, same, "left")
            .select("doc_id", "key", F.col("spans").alias("base"), F.array_sort(F.concat("spans", own)).alias("spans")))


def _text_of(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return spans_of(docs).select("doc_id", *map(_count, KINDS[:4]), F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced: ``[EMAIL]`` and so on, nothing for a removed term, ``[TERM]`` for a generalised one."""
    found = (spans_of(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"),
             F.transform("spans", lambda s: s.dropFields("value")).alias("_spans")).dropDuplicates(["_id", "_key"]))
    found = _light(written(found, "private-found"), "_spans")
    first = F.struct(F.lit(0).alias("to"), F.lit("").alias("text"))
    mark = F.array(*map(F.lit, ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[TERM]")))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, acc["to"] + 1, s["start"] - acc["to"])
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"),
                        F.when(s["start"] < acc["to"], acc["text"]).otherwise(F.concat(acc["text"], between, F.get(mark, s["k"]))).alias("text"))

    clean = F.aggregate("_spans", first, step, lambda acc: F.concat(acc["text"], F.substr(text, acc["to"] + 1, F.length(text))))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    out = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    return joined.select(F.col("_row").withField("text", out).alias("_row")).select("_row.*")
