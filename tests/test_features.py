"""F1-F16: worked cases, and Spark against the DuckDB twin on random strings."""

import duckdb
import pytest

from promptledger import settings as S
from promptledger.functions import text as tx


# Each text with its non-zero features, worked out by hand from the definitions.
CASES = [
    ('',
     dict()),
    ('   ',
     dict(token_count=0.75, char_count=3)),
    ('Extract the emails.',
     dict(token_count=4.75, char_count=19, word_count=3, sentence_count=1, context_length=2.75, instruction_keywords=1)),
    ('Please listen: is this ok?',
     dict(token_count=6.5, char_count=26, word_count=5, sentence_count=1, output_format_complexity=1, question_count=1, instruction_keywords=2)),
    ('Implement a parser. Then, write a test. Finally, ship it.',
     dict(token_count=14.25, char_count=57, word_count=10, sentence_count=3, complexity_keywords=3, context_length=6.25, instruction_keywords=1, multi_step_signals=2)),
    ('1. first\n2) second\tthird',
     dict(token_count=6, char_count=24, word_count=5, sentence_count=2, has_numbered_list=1, multi_step_signals=2)),
    ('What is 2+2?? Really?!',
     dict(token_count=5.5, char_count=22, word_count=4, sentence_count=2, question_count=3, instruction_keywords=1)),
    ('Summarize: the text\xa0with\u2003odd spaces',
     dict(token_count=8.75, char_count=35, word_count=6, sentence_count=1, context_length=6, instruction_keywords=1)),
    ('```python\nprint(1)\n``` Write a comprehensive, production-ready end-to-end design',
     dict(token_count=20, char_count=80, word_count=9, sentence_count=1, has_code_block=1, has_numbered_list=1, complexity_keywords=4, context_length=12.75, instruction_keywords=1, multi_step_signals=2)),
    ('You must ALWAYS answer in JSON table format, strictly.',
     dict(token_count=13.5, char_count=54, word_count=9, sentence_count=1, num_constraints=3, output_format_complexity=2)),
    ('Translate. Convert! Check? Count: Find, list',
     dict(token_count=11, char_count=44, word_count=6, sentence_count=4, output_format_complexity=1, context_length=8.25, question_count=1, instruction_keywords=6)),
    ('analyse the trade-off and tradeoff; evaluate the impact and strategy framework',
     dict(token_count=19.5, char_count=78, word_count=11, sentence_count=1, reasoning_keywords=7)),
    ('Step 1 do this. Step 2 do that. 3) and more',
     dict(token_count=10.75, char_count=43, word_count=11, sentence_count=3, has_numbered_list=1, multi_step_signals=3)),
    ('The extracted values; re-extract them, then EXTRACT!!  all   of\tthem',
     dict(token_count=17, char_count=68, word_count=10, sentence_count=2, context_length=2.75, instruction_keywords=1)),
    ('nothing here but what is this',
     dict(token_count=7.25, char_count=29, word_count=6, sentence_count=1, instruction_keywords=2)),
    ('please list:',
     dict(token_count=3, char_count=12, word_count=2, sentence_count=1, output_format_complexity=1, instruction_keywords=1)),
    ('count',
     dict(token_count=1.25, char_count=5, word_count=1, sentence_count=1, instruction_keywords=1)),
    ('Tokens before\xa0write\u2003after  the\n\nword',
     dict(token_count=9, char_count=36, word_count=6, sentence_count=1, context_length=3.5, instruction_keywords=1)),
]


def test_features_of_worked_cases(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, prompt string")
    got = {r.i: r.asDict() for r in tx.add_features(df).collect()}
    for i, (text, want) in enumerate(CASES):
        assert {n: got[i][n] for n in S.FEATURE_NAMES} == {n: float(want.get(n, 0)) for n in S.FEATURE_NAMES}, text


def test_keyword_counts_distinct_entries(spark):
    df = spark.createDataFrame([("must must must implement a thing",)], "prompt string")
    r = tx.add_features(df).first()
    assert r.num_constraints == 1.0
    assert r.complexity_keywords == 2.0  # 'implement a' and 'implement'


def test_multi_step_capped_at_three(spark):
    df = spark.createDataFrame([("first, then, finally, additionally, step 1 1. x",)], "prompt string")
    assert tx.add_features(df).first().multi_step_signals == 3.0


def test_token_estimates(spark):
    df = spark.createDataFrame([("abcdefghij one two",)], "text string")
    r = df.select(*tx.token_estimates("text")).first()
    assert (r.est_tokens_chars, r.est_tokens_words) == (4, 4)


def test_features_fire_on_prompt_fixture(spark):
    from conftest import SF_SMALL
    from promptledger.sources import fixtures as fx
    f = tx.add_features(fx.prompts(spark, SF_SMALL))
    fired = f.agg(*[__import__("pyspark.sql.functions", fromlist=["x"]).max(n).alias(n)
                    for n in S.FEATURE_NAMES]).first()
    assert all(v > 0 for v in fired.asDict().values())


def test_no_python_udf_in_feature_plan(spark):
    df = spark.createDataFrame([("Write a list",)], "prompt string")
    plan = tx.add_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_method_of_the_features_is_too_long_to_be_compiled(spark, tmp_dir):
    """The JVM interprets methods of more than 8,000 bytes of bytecode."""
    spark.createDataFrame([("Write a list",)], "prompt string").write.parquet(f"{tmp_dir}/prompts")
    plan = tx.add_features(spark.read.parquet(f"{tmp_dir}/prompts"))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert max(sizes, default=0) <= 8_000, sizes


def test_entries_in_every_list_and_in_none(spark):
    every = " ".join(S.CONSTRAINT_WORDS + S.REASONING_WORDS + S.COMPLEXITY_WORDS + S.INSTRUCTION_WORDS + S.STEP_MARKERS)
    r = tx.add_features(spark.createDataFrame([(every,), (None,), ("",)], "prompt string")).collect()
    names = ("num_constraints", "reasoning_keywords", "complexity_keywords", "instruction_keywords", "output_format_complexity")
    assert [r[0][n] for n in names] == [9.0, 22.0, 12.0, 16.0, 1.0]
    assert [r[i][n] for i in (1, 2) for n in names] == [0.0] * 10


def test_features_match_on_random_strings(spark):
    """400 seeded random strings over an alphabet of separators,
    Unicode white space, digits and keyword fragments, in one DataFrame."""
    import random
    rng = random.Random(7)
    atoms = ["a", "b", " ", "  ", ".", "!", "?", "...", "\t", "\n", " ", " ", "　", "1", "2)",
             "3.", ")", "list", "write", "Count,", "extract:", "is this", "step 1", "```", "json", "must",
             "analyze", "first,", "then,", "ü", "İ"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, prompt string")
    got = {r.i: r.asDict() for r in tx.add_features(df).collect()}
    con = duckdb.connect()
    con.execute("create table t (i int, prompt varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    twin = con.execute("select i, " + ", ".join(f"{e} as {n}" for n, e in tx.sql_features("prompt").items()) + " from t").fetchall()
    for i, *values in twin:
        for name, want in zip(tx.sql_features("prompt"), values):
            if name == "context_length" and "İ" in texts[i]:
                continue  # documented: lengths taken on the lower-cased rest
            assert got[i][name] == pytest.approx(want), (name, texts[i])
    words = {r.i: r.est_tokens_words for r in df.select("i", *tx.token_estimates("prompt")).collect()}
    assert all(words[i] == len(t.split()) * 4 // 3 for i, t in enumerate(texts))


def test_every_template_holds_the_whole_text(spark):
    from promptledger.sources.fixtures import templated
    body = "start " + "word " * 2_000 + "end"
    rows = [(i, body, "en") for i in range(12)]
    out = templated(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text")
    assert out.count() == 12 and all(body in r["prompt"] for r in out.collect())
