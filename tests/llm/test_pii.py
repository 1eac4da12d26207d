import hashlib
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "", None, "mail é🦊 bob.x+1@mail.example.com, c@d a@b@c.de x..y@z.a.b. -@-.-", "a@b.com_x@y.com.", "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 00000000000000000000000000001.2.3.4 99999999999999999999999.1.1.1",
    "card 4425 4142 5915 7784 or 4785380592391139 and 4785380592391138 4111-1111-1111-1111-", "call +1 (319) 555-5132. +1 5, ++44 20 7946 0958 +123456789012345678", "+49 30 4425414259157784 12-" * 3,
    "4" * 20_000, "x" * 50_000, "1.2.3.4@5.6.7.8", "5 " * 9000, "é1.1.1.1é", "write to bob [at] example [dot] com or (319) 555-5132, 4111.1111.1111.1111",
]


def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")


def test_base_equals_brute_force(spark):
    for r in pii.find_spans(rows(spark)).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == brute(TEXTS[r.id]), TEXTS[r.id]
        assert [tuple(s) for s in r.spans] == sorted(tuple(s) for s in r.spans)


def test_nothing_in_clean_or_empty_tables(spark):
    assert pii.find_spans(rows(spark).limit(0)).count() == 0
    clean = spark.createDataFrame([(1, "Plain prose, version 3.0."), (None, None)], "doc_id long, text string")
    assert [list(r.spans) for r in pii.find_spans(clean).collect()] == [[], []]


def test_method_adds_spans(spark):
    texts = [f"contact mail me{i}@site{i}.example.com now" for i in range(200)] + ["email me [at] site.example.com now"]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("id = 200").first().spans
    assert [(s.start, s.end, s.base) for s in got] == [(6, 30, False)]


def test_luhn(spark):
    numbers = ["4785380592391139", "4785380592391138", "0", "18", "79927398713"]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select(pii.luhn(F.col("n")).alias("ok")).collect()
    assert [r.ok for r in got] == [luhn(n) for n in numbers]


def test_estimation_learns_reliable_labelers():
    counts = {("1", "1", "1", "0", "1"): 900, ("-1", "-1", "-1", "0", "1"): 500, ("0", "1", "1", "0", "1"): 20, ("0", "-1", "-1", "0", "1"): 20}
    found, reliability = pii.estimate(counts)
    assert found[("0", "1", "1", "0", "1")] > 0.9 and found[("0", "-1", "-1", "0", "1")] < 0.1
    assert all(0.5 < x <= 1 for x in reliability[1:3]) and pii.train({}) == pii.Model({}, {})


def test_query_columns(spark):
    joined = rows(spark).transform(pii.find_spans).select("id", F.sha2(pii.joined(F.filter("spans", lambda x: x["base"])), 256).alias("h")).collect()
    for r in joined:
        text = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in brute(TEXTS[r.id]))
        assert r.h == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_take_linear_time(spark):
    """Runs that no pattern accepts must not be scanned again from each of their characters."""
    import time

    n = 200_000
    texts = ["1" * n + " 1.2", "1.2." * (n // 8), "a" * n + "@", "+1" + "(" * n, "x1" * (n // 2), "+" * n, "5 " * (n // 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    began = time.perf_counter()
    assert pii.candidates(docs).selectExpr("max(size(found)) as n").first().n == n // 8 // 2 + 1
    assert time.perf_counter() - began < 90


def test_secrets_are_added_with_precision(spark):
    """Planted tokens are found by votes; long words, addresses and checksums that are named so are not."""
    texts = [f'set token = "{hashlib.sha1(str(i).encode()).hexdigest()}" here' for i in range(60)]
    texts += [f"see https://site.example.com/path/to/page-{i}/index.html now" for i in range(60)] + [f"commit {hashlib.sha1(b'c' + bytes([i])).hexdigest()}x done" for i in range(20)]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {r.id for r in got if any(s.kind == 4 for s in r.spans)}
    assert added == set(range(60))
    assert all(s.probability >= 0.9 and not s.base and s.end - s.start == 40 for r in got for s in r.spans if s.kind == 4)


if __name__ == "__main__":
    pytest.main([__file__])
