"""DuckDB SQL twins of the registered queries (the correctness oracle).

The fixture views of :mod:`promptledger.sources.fixtures` are written
once more here as CTEs over the driver's tables; each oracle query is
``WITH <views it needs> <select>``.  Config rows and word lists come from
:mod:`promptledger.settings`, so both sides read the same values.
"""

from __future__ import annotations

from decimal import Decimal

from .. import settings as S
from ..functions import text as TX
from ..sources.fixtures import FENCE, PROMPT_TEMPLATES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _per_token(p: str) -> str:
    return f"CAST({_q(format(Decimal(p) / 1000, 'f'))} AS DECIMAL(18,12))"


def _registry_values() -> str:
    rows = []
    for i, (key, prov, mid, pin, pout, q, lat, name) in enumerate(S.MODEL_REGISTRY):
        rows.append(f"({_q(key)}, {_q(prov)}, {_q(mid)}, CAST({_q(pin)} AS DECIMAL(18,8)), "
                    f"CAST({_q(pout)} AS DECIMAL(18,8)), {_q(q)}, {lat}, {_q(name)}, {i}, "
                    f"{_per_token(pin)}, {_per_token(pout)})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(model_key, provider, model_id, "
            "cost_per_1k_input_usd, cost_per_1k_output_usd, quality_tier, avg_latency_ms, display_name, "
            "registry_order, price_in_per_token, price_out_per_token)")


def _cost(i: str, o: str, pin: str, pout: str) -> str:
    return (f"CAST(round(CAST({i} AS DECIMAL(12,0)) * {pin} + CAST({o} AS DECIMAL(12,0)) * {pout}, 8) "
            f"AS DECIMAL(18,8))")


T = S.DEFAULT_THRESHOLDS
R = S.ROUTING

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


view("registry", [], _registry_values())
view("best_model", ["registry"], """
SELECT * FROM registry WHERE quality_tier = 'high'
ORDER BY cost_per_1k_input_usd + cost_per_1k_output_usd DESC, registry_order LIMIT 1""")
view("cheapest_model", ["registry"], """
SELECT model_key FROM registry ORDER BY cost_per_1k_input_usd, registry_order LIMIT 1""")
view("routing_rules", [], "SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {_q(R[f'tier_{t}_model'])})" for t in (1, 2, 3)) + ") AS r(tier, model_key)")

_base = f"""
SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, user_id, event_type,
  CASE WHEN k < 35 THEN 1 WHEN k < 75 THEN 2 ELSE 3 END AS complexity_tier,
  CAST(40 + (event_id * 37) % 60 AS DOUBLE) / CAST(100 AS DOUBLE) AS classifier_conf,
  CAST(20 + (event_id * 13) % 480 AS BIGINT) AS input_tokens,
  CAST(10 + k * 3 + (event_id * 7) % 50 AS BIGINT) AS output_tokens,
  value * CAST(40 AS DOUBLE) AS latency_ms,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN CAST(-1.0 AS DOUBLE)
       ELSE CAST(10 + (event_id * 7) % 41 AS DOUBLE) / CAST(10 AS DOUBLE) END AS quality_score,
  CAST(30 + (event_id * 11) % 21 AS DOUBLE) / CAST(10 AS DOUBLE) AS expensive_score,
  CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 6 <> 0
       THEN 'misses point ' || CAST(event_id % 6 AS VARCHAR) END AS judge_reason
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

view("request_log", ["registry", "best_model", "cheapest_model", "routing_rules"], f"""
SELECT b.*,
  {_cost('b.input_tokens', 'b.output_tokens', 'p.price_in_per_token', 'p.price_out_per_token')} AS cost_usd,
  {_cost('b.input_tokens', 'b.output_tokens', '(SELECT price_in_per_token FROM best_model)',
         '(SELECT price_out_per_token FROM best_model)')} AS cost_if_highest_quality,
  CASE WHEN b.quality_score IS NULL OR b.quality_score < 0 THEN 'unverified'
       WHEN NOT (b.quality_gap > CAST({T.gap_threshold} AS DOUBLE) OR b.quality_score < CAST({T.min_cheap_score} AS DOUBLE))
         THEN 'routing_correct'
       WHEN CAST({T.budget_ms} AS DOUBLE) - b.latency_ms < CAST({T.reserve_ms} AS DOUBLE) THEN 'latency_budget_exhausted'
       ELSE 'escalate' END AS decision
FROM (
  SELECT g.*, g.classifier_conf < CAST({R['low_confidence_threshold']} AS DOUBLE) AS low_confidence,
    CASE WHEN g.classifier_conf < CAST({R['low_confidence_threshold']} AS DOUBLE) THEN {_q(R['fallback_model'])}
         ELSE (SELECT model_key FROM routing_rules rr WHERE rr.tier = g.complexity_tier) END AS routed_model
  FROM (SELECT *, CASE WHEN quality_score < 0 THEN CAST(0.0 AS DOUBLE) ELSE expensive_score - quality_score END
          AS quality_gap FROM ({_base})) g) b
LEFT JOIN registry p ON p.model_key = coalesce(
    (SELECT model_key FROM registry x WHERE x.model_key = b.routed_model), (SELECT model_key FROM cheapest_model))""")


def _prompt_expr() -> str:
    cases = []
    for i, (prefix, suffix, fenced) in enumerate(PROMPT_TEMPLATES):
        if fenced:
            e = f"{_q(prefix)} || {_q(FENCE)} || body || {_q(FENCE.rstrip(chr(10)))} || {_q(suffix)}"
        else:
            e = f"{_q(prefix)} || body || {_q(suffix)}"
        cases.append(f"WHEN doc_id % 12 = {i} THEN {e}")
    return "CASE " + " ".join(cases) + " END"


view("prompts", [], f"""
SELECT doc_id, lang, {_prompt_expr()} AS prompt,
  CAST(CASE WHEN doc_id % 12 <= 3 THEN 1 WHEN doc_id % 12 <= 7 THEN 2 WHEN doc_id % 12 <= 10 THEN 3
       ELSE 1 + (doc_id // 12) % 3 END AS INTEGER) AS label
FROM (SELECT doc_id, lang, coalesce(text, '') AS body FROM documents)""")


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"


# ------------------------------------------------------------ B.3 views

view("completions", ["request_log"], """
SELECT id AS prompt_id, 'large' AS model_key, 'reference answer ' || CAST(id AS VARCHAR) AS output_text,
  input_tokens, output_tokens + id % 17 - again AS output_tokens,
  latency_ms * CAST(0.5 AS DOUBLE) + CAST(100.0 AS DOUBLE) AS latency_ms
FROM request_log, (SELECT unnest([0, 1]) AS again) WHERE id % 11 <> 0 AND (again = 0 OR id % 5 = 0)""")

_full = ("'{\"cheap_score\": ' || printf('%.1f', quality_score) || ', \"expensive_score\": ' || "
         "printf('%.1f', expensive_score) || ', \"quality_gap\": 99.0, \"routing_correct\": ' || "
         "(CASE WHEN decision = 'routing_correct' THEN 'true' ELSE 'false' END) || ', \"failure_reason\": null}'")
_partial = ("'{\"cheap_score\": ' || printf('%.1f', quality_score) || ', \"quality_gap\": 99.0, "
            "\"routing_correct\": ' || (CASE WHEN decision = 'routing_correct' THEN 'true' ELSE 'false' END) || '}'")
view("verdict_text", ["request_log"], f"""
SELECT id, ts, CASE id % 5 WHEN 0 THEN {_full}
  WHEN 1 THEN '```json' || chr(10) || {_full} || chr(10) || '```'
  WHEN 2 THEN 'Here is my assessment:' || chr(10) || {_full} || chr(10) || 'Thanks.'
  WHEN 3 THEN {_partial}
  ELSE 'I cannot score these answers.' END AS raw
FROM request_log WHERE quality_score >= 0""")

_WSC = TX.WS
_stripped = f"regexp_replace(regexp_replace(raw, {_q('^' + _WSC + '+')}, ''), {_q(_WSC + '+$')}, '')"


def parsed_sql(src: str) -> str:
    """V2-V5 over ``src`` (a relation with ``raw``)."""
    return f"""
SELECT * EXCLUDE (js, keys, c, e, rc, fr),
  CASE WHEN parse_error IS NULL THEN c ELSE CAST({S.VERIFY_FAILED_SENTINEL} AS DOUBLE) END AS quality_score,
  CASE WHEN parse_error IS NULL THEN e END AS expensive_score,
  CASE WHEN parse_error IS NULL THEN e - c ELSE CAST(0.0 AS DOUBLE) END AS quality_gap,
  CASE WHEN parse_error IS NULL THEN
    CASE WHEN rc IS NULL THEN false WHEN lower(rc) = 'false' THEN false WHEN lower(rc) = 'true' THEN true
         WHEN TRY_CAST(rc AS DOUBLE) IS NOT NULL THEN TRY_CAST(rc AS DOUBLE) <> 0 ELSE rc <> '' END
    ELSE false END AS judge_routing_correct,
  CASE WHEN parse_error IS NULL THEN fr ELSE parse_error END AS failure_reason
FROM (
  SELECT *, CASE WHEN keys IS NULL THEN 'not_json'
                 WHEN NOT list_has_all(keys, ['cheap_score', 'expensive_score', 'quality_gap', 'routing_correct'])
                   THEN 'missing_keys'
                 WHEN c IS NULL OR e IS NULL THEN 'bad_value' END AS parse_error
  FROM (
    SELECT *, CASE WHEN keys IS NOT NULL THEN TRY_CAST(json_extract_string(js, '$.cheap_score') AS DOUBLE) END AS c,
      CASE WHEN keys IS NOT NULL THEN TRY_CAST(json_extract_string(js, '$.expensive_score') AS DOUBLE) END AS e,
      CASE WHEN keys IS NOT NULL THEN json_extract_string(js, '$.routing_correct') END AS rc,
      CASE WHEN keys IS NOT NULL THEN json_extract_string(js, '$.failure_reason') END AS fr
    FROM (
      SELECT *, CASE WHEN json_valid(js) AND json_type(js) = 'OBJECT' THEN json_keys(js) END AS keys
      FROM (
        SELECT *, CASE WHEN regexp_extract(raw, {_q(r'(?s)\{.*\}')}, 0) <> ''
                       THEN regexp_extract(raw, {_q(r'(?s)\{.*\}')}, 0) ELSE {_stripped} END AS js
        FROM {src}))))"""


view("parsed_verdicts", ["verdict_text"], parsed_sql("verdict_text"))
view("verdicts", ["parsed_verdicts"], """
SELECT id, quality_score, ts + INTERVAL 1 MINUTE + to_seconds(id % 300) AS verified_at FROM parsed_verdicts
UNION ALL
SELECT id, CAST(5.0 AS DOUBLE) AS quality_score, ts + INTERVAL 30 SECOND AS verified_at
FROM parsed_verdicts WHERE id % 4 = 0""")

view("failures", ["request_log", "prompts"], f"""
SELECT CASE WHEN request_id >= 0 THEN request_id * 10 + 1 ELSE -request_id * 10 + 2 END AS id,
  request_id, ts, p.prompt, classified_tier, correct_tier, quality_gap, failure_reason
FROM (
  SELECT id AS request_id, ts, complexity_tier AS classified_tier,
    CAST(least(3, complexity_tier + CASE WHEN quality_gap > CAST({T.bump_gap} AS DOUBLE) THEN 2 ELSE 1 END)
      AS INTEGER) AS correct_tier, quality_gap, judge_reason AS failure_reason
  FROM request_log WHERE decision IN ('escalate', 'latency_budget_exhausted')
  UNION ALL
  SELECT -(id + 1), ts, complexity_tier, 3, CAST(2.0 AS DOUBLE), 'unknown request' FROM request_log WHERE id % 1000 = 0
) f LEFT JOIN prompts p ON p.doc_id = abs(f.request_id) % (SELECT count(*) FROM documents)""")
view("ledger", ["failures"], "SELECT id AS failure_id FROM failures WHERE id % 3 = 0")
view("predictions", ["prompts"], """
SELECT doc_id, label, CAST(CASE WHEN doc_id % 9 = 0 THEN 1 + label % 3 ELSE label END AS INTEGER) AS predicted
FROM prompts""")

_keys_list = "[" + ", ".join(_q(m[0]) for m in S.MODEL_REGISTRY) + "]"
view("baseline_runs", ["prompts"], f"""
SELECT doc_id AS prompt_index, label AS expected_tier, model_key, ok AS success,
  CASE WHEN ok THEN CAST(floor(length(prompt) / 4) AS BIGINT) END AS input_tokens,
  CASE WHEN ok THEN CAST(40 + doc_id % 200 * factor AS BIGINT) END AS output_tokens,
  CASE WHEN ok THEN CAST(200.0 AS DOUBLE) + CAST(doc_id % 97 AS DOUBLE) * CAST(3.0 AS DOUBLE) * CAST(factor AS DOUBLE)
  END AS latency_ms
FROM (SELECT p.*, m.model_key,
        CASE m.model_key WHEN 'large' THEN 3 WHEN 'mid' THEN 2 ELSE 1 END AS factor,
        NOT (doc_id % 13 = 0 AND m.model_key = 'mid') AS ok
      FROM prompts p, (SELECT unnest({_keys_list}) AS model_key) m)""")
view("priced_runs", ["baseline_runs", "registry", "best_model"], f"""
SELECT r.*,
  {_cost('r.input_tokens', 'r.output_tokens', 'g.price_in_per_token', 'g.price_out_per_token')} AS cost_usd,
  {_cost('r.input_tokens', 'r.output_tokens', '(SELECT price_in_per_token FROM best_model)',
         '(SELECT price_out_per_token FROM best_model)')} AS cost_if_highest_quality
FROM baseline_runs r LEFT JOIN registry g ON g.model_key = r.model_key""")

view("chat_requests", [], """
SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 1 THEN '' ELSE text END AS content,
  CASE WHEN conv_id % 7 = 5 THEN 9000 WHEN conv_id % 7 = 3 THEN 0 END AS max_tokens,
  CASE WHEN conv_id % 7 = 2 THEN CAST(5.0 AS DOUBLE) WHEN conv_id % 7 = 6 THEN CAST(1.5 AS DOUBLE) END AS temperature,
  CASE WHEN conv_id % 7 = 0 THEN 'user-' || CAST(conv_id AS VARCHAR) END AS user_id,
  conv_id % 7 = 4 AS __dropped
FROM conversations""")
