"""Prompt text features F1-F16 as built-in column expressions.

No UDF: every feature is a JVM-side expression, so featurising scales with
the scan.  Each expression has
a DuckDB twin generated from the same word lists (used by the oracle).

Semantics (per feature, see README):
* keyword features count how many *distinct list entries* occur as
  substrings of the lower-cased prompt;
* words are runs of non-white-space, where white space is the set of
  characters ``str.isspace`` accepts (written out as a regex class so the
  JVM and RE2 agree);
* digits in the numbered-list pattern are ASCII ``0-9``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S

# code point ranges that str.isspace() accepts
_WS_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
              (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
              (0x3000, 0x3000)]


def _cls(negate: bool = False) -> str:
    parts = []
    for a, b in _WS_RANGES:
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "[" + ("^" if negate else "") + "".join(parts) + "]"


WS = _cls()               # one white-space character
NON_WS = _cls(True)       # one non-white-space character
WS_RUN = WS + "+"
SENTENCE_SPLIT = "[.!?]+"
NUMBERED_LIST = "[0-9]+[.)]" + WS
FOLDED_NUMBERED_LIST = "[0-9]+[.)] "
TRAIL_CLASS = "[" + "".join("\\" + ch for ch in S.WORD_TRAIL_PUNCT) + "]"
TRAIL_PUNCT = TRAIL_CLASS + "+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _entries(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _hits(lowered: Column, words) -> Column:
    """Number of distinct entries of ``words`` found in ``lowered``.

    A filter over the literal list instead of one branch per entry: the
    branches of all lists fused into one generated method of more than 8,000
    bytes of bytecode, which the JVM never compiles but interprets."""
    return F.size(F.filter(_entries(words), lambda w: lowered.contains(w))).cast("double")


def words(text) -> Column:
    """``str.split()``: white-space runs split, empty pieces dropped (the
    white space folded to single spaces first, see :func:`fold_ws`)."""
    return _tokens(fold_ws(_col(text)))


def token_estimate(text) -> Column:
    """F1 (the documented fallback): characters / 4 as a double."""
    return F.length(_col(text)) / F.lit(4.0)


# single-token instruction words (an entry with a space can never equal one
# white-space-free token, so those entries never fire here)
_TOKEN_WORDS = [w for w in S.INSTRUCTION_WORDS if " " not in w]
WS_CHARS = "".join(chr(c) for a, b in _WS_RANGES for c in range(a, b + 1))
# on text whose white space is folded to " ": lazily skip to the first token
# that is an instruction word followed only by trailing punctuation and
# capture everything after the space behind it
_FIRST_INSTRUCTION = ("(?s)^.*?(?:^| )(?:" + "|".join(_TOKEN_WORDS) + ")" + TRAIL_CLASS + "*(?: (.*))?$")


def fold_ws(c) -> Column:
    """Every white-space character to one plain space (a per-character
    table lookup, no regex), so later splits use the single-character path."""
    return F.translate(_col(c), WS_CHARS, " " * len(WS_CHARS))


def _tokens(folded: Column) -> Column:
    """Tokens of white-space-folded text: a single-character split, empty
    pieces removed with ``array_remove`` (no lambda, so it stays in codegen)."""
    return F.array_remove(F.split(folded, " "), "")


def sentence_count(folded: Column) -> Column:
    """F4 on white-space-folded text: parts between runs of ``.!?`` that hold
    a non-white-space character.  Deleting the white space first turns a
    blank part into an empty one (two runs around a blank part merge), so
    the count is the non-empty parts of one split, with no per-part regex."""
    return F.size(F.array_remove(F.split(F.replace(folded, F.lit(" "), F.lit("")), SENTENCE_SPLIT), ""))


def context_length(text, folded_lower=None) -> Column:
    """tokens after the first word that, lower-cased and right-stripped
    of ``.,?:!``, is an instruction word; 0.0 when there is none.

    One regex pass over the lower-cased, white-space-folded text finds the
    word and captures the rest (lower-casing and folding keep token
    boundaries); the re-joined length is non-space characters plus one
    separator per gap.  (Lengths are taken on the lower-cased rest; they
    differ from the original only for U+0130, whose lower case is two code
    points.)"""
    fl = fold_ws(F.lower(_col(text))) if folded_lower is None else _col(folded_lower)
    rest = F.regexp_extract(fl, _FIRST_INSTRUCTION, 1)
    n = F.size(_tokens(rest))
    joined = F.length(F.replace(rest, F.lit(" "), F.lit(""))) + F.greatest(n - 1, F.lit(0))
    return joined.cast("double") / F.lit(4.0)


def add_features(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    """Append the 14 feature columns (F1-F14) to ``df``.

    Two projections: the lower-cased text is materialised once per row
    (Catalyst keeps a non-cheap expression that is used many times in its
    own projection) and every keyword test reads it.
    """
    t = F.col(text_col)
    lowered, folded = "__pl_lower", "__pl_folded"
    staged = df.withColumn(lowered, F.lower(t))
    staged = staged.withColumn(folded, fold_ws(F.col(lowered)))
    lo, fl = F.col(lowered), F.col(folded)
    # folding and lower-casing keep digits, ``.``, ``)`` and every white-space
    # position, so the numbered-list test can read the folded text
    numbered = F.when(fl.rlike(FOLDED_NUMBERED_LIST), F.lit(1.0)).otherwise(F.lit(0.0))
    feats = {
        "token_count": token_estimate(t),
        "char_count": F.length(t).cast("double"),
        "word_count": F.size(_tokens(fl)).cast("double"),
        "sentence_count": sentence_count(fl).cast("double"),
        "has_code_block": F.when(t.contains("```"), F.lit(1.0)).otherwise(F.lit(0.0)),
        "has_numbered_list": numbered,
        "num_constraints": _hits(lo, S.CONSTRAINT_WORDS),
        "reasoning_keywords": _hits(lo, S.REASONING_WORDS),
        "complexity_keywords": _hits(lo, S.COMPLEXITY_WORDS),
        "output_format_complexity": (
            F.when(F.exists(_entries(S.STRUCTURED_OUTPUT_WORDS), lambda w: lo.contains(w)), F.lit(2.0))
            .when(F.exists(_entries(S.LIST_OUTPUT_WORDS), lambda w: lo.contains(w)), F.lit(1.0))
            .otherwise(F.lit(0.0))),
        "context_length": context_length(t, fl),
        "question_count": (F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))).cast("double"),
        "instruction_keywords": _hits(lo, S.INSTRUCTION_WORDS),
        "multi_step_signals": F.least(F.lit(3.0), _hits(lo, S.STEP_MARKERS) + numbered),
    }
    out = staged.select("*", *[feats[n].alias(n) for n in S.FEATURE_NAMES])
    return out.drop(lowered, folded)


def token_estimates(text_col: str = "text", words_col: str | None = None) -> list[Column]:
    """F16: integer ``len // 4`` and the pre-call ``words * 4 // 3`` estimate."""
    t = F.col(text_col)
    n_words = F.size(words(t)) if words_col is None else F.col(words_col)
    return [F.floor(F.length(t) / F.lit(4)).cast("bigint").alias("est_tokens_chars"),
            F.floor(n_words * F.lit(4) / F.lit(3)).cast("bigint").alias("est_tokens_words")]


# ---------------------------------------------------------------- SQL twin

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_hits(lo: str, ws) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({lo}, {_q(w)}) THEN 1.0 ELSE 0.0 END" for w in ws) + ")"


def sql_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {_q(WS_RUN)}), lambda x: x <> '')"


def sql_features(t: str) -> dict[str, str]:
    """DuckDB expressions of the 14 features over the SQL text expression ``t``."""
    lo = f"lower({t})"
    numbered = f"CASE WHEN regexp_matches({t}, {_q(NUMBERED_LIST)}) THEN 1.0 ELSE 0.0 END"
    any_struct = " OR ".join(f"contains({lo}, {_q(w)})" for w in S.STRUCTURED_OUTPUT_WORDS)
    any_list = " OR ".join(f"contains({lo}, {_q(w)})" for w in S.LIST_OUTPUT_WORDS)
    lookup = "[" + ", ".join(_q(w) for w in S.INSTRUCTION_WORDS) + "]"
    ws = sql_words(t)
    pos = (f"coalesce(list_position(list_transform({ws}, lambda w: list_contains({lookup}, "
           f"regexp_replace(lower(w), {_q(TRAIL_PUNCT)}, ''))), true), 0)")
    rest = f"array_to_string(list_slice({ws}, {pos} + 1, len({ws})), ' ')"
    exprs = {
        "token_count": f"CAST(length({t}) AS DOUBLE) / 4.0",
        "char_count": f"CAST(length({t}) AS DOUBLE)",
        "word_count": f"CAST(len({ws}) AS DOUBLE)",
        "sentence_count": (f"CAST(len(list_filter(regexp_split_to_array({t}, {_q(SENTENCE_SPLIT)}), "
                           f"lambda x: regexp_matches(x, {_q(NON_WS)}))) AS DOUBLE)"),
        "has_code_block": f"CASE WHEN contains({t}, '```') THEN 1.0 ELSE 0.0 END",
        "has_numbered_list": numbered,
        "num_constraints": _sql_hits(lo, S.CONSTRAINT_WORDS),
        "reasoning_keywords": _sql_hits(lo, S.REASONING_WORDS),
        "complexity_keywords": _sql_hits(lo, S.COMPLEXITY_WORDS),
        "output_format_complexity": f"CASE WHEN {any_struct} THEN 2.0 WHEN {any_list} THEN 1.0 ELSE 0.0 END",
        "context_length": (f"CASE WHEN {pos} = 0 THEN 0.0 ELSE CAST(length({rest}) AS DOUBLE) / 4.0 END"),
        "question_count": f"CAST(length({t}) - length(replace({t}, '?', '')) AS DOUBLE)",
        "instruction_keywords": _sql_hits(lo, S.INSTRUCTION_WORDS),
        "multi_step_signals": f"least(3.0, {_sql_hits(lo, S.STEP_MARKERS)} + {numbered})",
    }
    # DuckDB types 1.0 / 0.0 literals as DECIMAL
    return {n: f"CAST({e} AS DOUBLE)" for n, e in exprs.items()}


def sql_token_estimates(t: str) -> dict[str, str]:
    return {"est_tokens_chars": f"CAST(floor(length({t}) / 4) AS BIGINT)",
            "est_tokens_words": f"CAST(floor(len({sql_words(t)}) * 4 / 3) AS BIGINT)"}
