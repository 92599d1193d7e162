"""Judge verdicts: input text (V1), parsing (V2-V4), sentinel (V5) and the
latest-verdict merge onto the request log (K7 / J3).

Parsing is string extraction + ``try_cast`` rather than ``from_json``:
a typed schema turns ``"4"`` into null and cannot tell a missing key from
a null one.  Deviation, documented: a quoted ``"false"`` for
``routing_correct`` reads as false here (the service's truthiness reads it
as true); the flag is not used for decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.text import WS_CHARS

REQUIRED_KEYS = ["cheap_score", "expensive_score", "quality_gap", "routing_correct"]

# what the judge is asked to do (in our words) and the keys it must answer with
JUDGE_INSTRUCTIONS = (
    "Score how well each response answers the prompt, from 1.0 (useless) to 5.0 (complete and right). "
    "Answer with one JSON object and nothing else, with the keys " + ", ".join(REQUIRED_KEYS) + " and failure_reason: "
    "quality_gap is expensive_score minus cheap_score, routing_correct says whether the cheap response will do, "
    "failure_reason says in a few words what it lacks, or is null.")
OBJECT_SPAN = r"(?s)\{.*\}"


def judge_inputs(df: DataFrame, prompt: str = "prompt", cheap: str = "cheap_output",
                 reference: str = "reference_output") -> DataFrame:
    """V1: the judge's user message from prompt, cheap and reference output,
    and its instructions."""
    msg = F.concat(F.lit("ORIGINAL_PROMPT:\n"), F.col(prompt),
                   F.lit("\n\nRESPONSE_A (cheap model):\n"), F.col(cheap),
                   F.lit("\n\nRESPONSE_B (reference model):\n"), F.col(reference))
    return df.select("*", msg.alias("judge_input"), F.lit(JUDGE_INSTRUCTIONS).alias("judge_instructions"))


def _strip_ws(c: F.Column) -> F.Column:
    """``str.strip()``: white space (as ``str.isspace``) off both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def extract_json(raw) -> F.Column:
    """V2: from the first ``{`` to the last ``}``, whatever stands around it
    (fences, preamble); a text without such a span is left as it is."""
    text = F.col(raw) if isinstance(raw, str) else raw
    span = F.regexp_extract(text, OBJECT_SPAN, 0)
    return F.when(span != "", span).otherwise(_strip_ws(text))


def _truthy(v: F.Column) -> F.Column:
    num = v.try_cast("double")
    return (F.when(v.isNull(), F.lit(False))
            .when(F.lower(v) == "false", F.lit(False))
            .when(F.lower(v) == "true", F.lit(True))
            .when(num.isNotNull(), num != 0)
            .otherwise(v != ""))


def parse_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """V2-V5: parse verdict text into scores.

    Adds ``parse_error`` (null when valid: ``not_json``, ``missing_keys`` or
    ``bad_value``), the scores with the gap recomputed as expensive - cheap
    (V4), and ``quality_score``: the cheap score, or the -1.0 sentinel when
    the verdict could not be used (V5; gap 0, not correct)."""
    js = extract_json(raw)
    staged = df.withColumn("__js", js)
    j = F.col("__js")
    keys = F.json_object_keys(j)
    # a required key absent from the object's keys (no lambda: stays in codegen)
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), keys)) > 0
    cheap = F.get_json_object(j, "$.cheap_score").try_cast("double")
    exp = F.get_json_object(j, "$.expensive_score").try_cast("double")
    err = (F.when(keys.isNull(), F.lit("not_json"))
           .when(missing, F.lit("missing_keys"))
           .when(cheap.isNull() | exp.isNull(), F.lit("bad_value")))
    parsed = staged.select(
        *[F.col(c) for c in df.columns],
        err.alias("parse_error"),
        cheap.alias("cheap_score"),
        exp.alias("expensive_score"),
        _truthy(F.get_json_object(j, "$.routing_correct")).alias("judge_routing_correct"),
        F.get_json_object(j, "$.failure_reason").alias("failure_reason"),
    )
    ok = F.col("parse_error").isNull()
    return parsed.select(
        *[F.col(c) for c in df.columns], "parse_error",
        F.when(ok, F.col("cheap_score")).otherwise(F.lit(S.VERIFY_FAILED_SENTINEL)).alias("quality_score"),
        F.when(ok, F.col("expensive_score")).alias("expensive_score"),
        F.when(ok, F.col("expensive_score") - F.col("cheap_score")).otherwise(F.lit(0.0)).alias("quality_gap"),
        F.when(ok, F.col("judge_routing_correct")).otherwise(F.lit(False)).alias("judge_routing_correct"),
        F.when(ok, F.col("failure_reason")).otherwise(F.col("parse_error")).alias("failure_reason"),
    )


def latest_verdicts(verdicts: DataFrame, key: str = "id", at: str = "verified_at") -> DataFrame:
    """K7: the newest verdict per request id from an append-only table.

    ``max_by`` is a partial aggregate: each map task keeps one candidate
    per id before the shuffle, so an id with many verdicts (a hot key)
    costs one row per partition, not one row per verdict."""
    value_cols = [c for c in verdicts.columns if c != key]
    return (verdicts.groupBy(key)
            .agg(F.max_by(F.struct(*value_cols), F.struct(F.col(at), *[F.col(c) for c in value_cols if c != at]))
                 .alias("__v"))
            .select(key, "__v.*"))


def merge_verdicts(requests: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Requests left-joined to their latest verdict; unverified
    requests keep null ``quality_score`` / ``verified_at``."""
    latest = latest_verdicts(verdicts.select(key, "quality_score", "verified_at"), key)
    req = requests.drop("quality_score", "verified_at")
    return req.join(latest, key, "left")


def verification_status(df: DataFrame) -> F.Column:
    """V5: pending (null score), failed (sentinel) or verified."""
    q = F.col("quality_score")
    return (F.when(q.isNull(), F.lit("pending"))
            .when(q == F.lit(S.VERIFY_FAILED_SENTINEL), F.lit("failed"))
            .otherwise(F.lit("verified")))
