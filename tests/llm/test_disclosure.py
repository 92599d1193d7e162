"""Operator 5: base spans against Python's re, and disclosing terms."""

import hashlib
import random
import re

from llm_rows import nothing, odd, odd_rows  # noqa: F401  (fixtures)

from promptledger.llm import disclosure

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_of_random_texts(spark, odd_rows):
    rng = random.Random(8)
    atoms = ["a", "B.c", "@", "@x.y", ".", "_", "-", "1", "25", "255", "256", "007", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (555) 010-9999", "+",
             "10.0.0.1", " ", " ", "é", "(", ")", "日"]
    rows = [(100 + i, "".join(rng.choices(atoms, k=rng.randrange(1, 14)))) for i in range(1_500)] + odd_rows
    got = disclosure.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    found = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    want = []
    for i, t in rows:
        spans = brute(t or "")
        text = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(want)


def test_runs_are_read_once(spark):
    text = "a" * 200_000 + " " + "1" * 100_000 + " " + "a." * 50_000 + "@b" + ".c" * 50_000
    r = disclosure.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_card) == (1, 0, 0)


def planted(spark):
    """zorbax stands only near one address, in four contexts; plain words stand everywhere."""
    rows = [(i, f"note {'abcd'[i]} about zorbax who writes from jo.doe@mail.example to {w} today") for i, w in enumerate(("berlin", "paris", "rome", "oslo"))]
    rows += [(10 + i, "many people write about today and from there note who writes " * 40 + str(i)) for i in range(20)]
    return spark.createDataFrame(rows + [(50, None)], "doc_id long, text string")


def test_terms_that_disclose_are_removed_near_the_entity(spark):
    got = {r.doc_id: r.spans for r in disclosure.judge(planted(spark)).collect()}
    assert all("removed:13:19" in got[i].split(",") and "email:37:57" not in got[i] for i in range(4))
    assert all(got[i] == "" for i in [*range(10, 30), 50])
    clean = {r.doc_id: r.text for r in disclosure.sanitise(planted(spark)).collect()}
    assert clean[0] == "note a about  who writes from [EMAIL] to berlin today" and clean[50] is None


def test_sanitise_keeps_rows_and_columns(odd, odd_rows, nothing):
    out = disclosure.sanitise(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted((i, t or "") for i, t in odd_rows)
    assert disclosure.judge(nothing).count() == 0 and disclosure.sanitise(nothing).count() == 0


def test_every_occurrence_of_a_disclosing_term_is_touched(spark):
    """zorbax far from the address, in its document and in one without it; two copies prove nothing."""
    far = " ".join(["plain words"] * 20)
    rows = [(i, f"Zorbax note {w} {far} jo.doe@mail.example {far} zorbax") for i, w in enumerate(("berlin", "paris", "rome", "oslo", "bern", "wien", "riga", "kiev", "baku"))]
    rows += [(10, "here is zorbax alone, zorbaxes not"), (11, "copied quill al.roe@mail.example"), (12, "copied quill al.roe@mail.example")]
    rows += [(20 + i, f"note {far} copied {i}") for i in range(500)]
    clean = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[10] == "here is  alone, zorbaxes not" and clean[11] == clean[12] == "copied quill [EMAIL]"
    assert all(clean[i] == f" note {rows[i][1].split()[2]} {far} [EMAIL] {far} " for i in range(9))
    assert clean[20] == f"note {far} copied 0"
