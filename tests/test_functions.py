import math
import random

import pytest
from pyspark.sql import functions as F

from brinkline.functions import binning, code_metrics, probability, status, text
from brinkline.sources import scratch


def test_instruction_features(spark):
    rows = [
        ("Write a recursive function that will sort the list; if empty, return it, otherwise iterate for each item.", (18, 1, 1, 2, 1, 0, 2, 1, 5, 4.888888888888889)),
        ("Functions, classes and lists: validates sorted_list", (6, 0, 0, 0, 0, 0, 0, 0, 0, 7.666666666666667)),
        ("IF x When y: case-switch", (5, 4, 0, 0, 0, 0, 0, 0, 4, 4.0)),
        ("for  each item", (3, 0, 0, 0, 0, 0, 0, 0, 0, 11 / 3)),
        (" \t\n", (0,) * 9 + (0.0,)),
        (None, (0,) * 9 + (0.0,)),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.instruction_features(F.col("t")).alias("f")).orderBy("i").collect()
    for r, (_, want) in zip(got, rows, strict=True):
        assert tuple(r["f"]) == pytest.approx(want)


def test_unicode_words_and_blanks(spark):
    row = spark.createDataFrame([("ıf İf IF if_x if-x", "a\x1cb\x85c\xa0d\u200be")], "a string, b string").select(text.word_count(F.col("a"), ("if",)), text.token_count(F.col("b"))).first()
    assert tuple(row) == (4, 4)


def test_intent(spark):
    rows = [("Sort the street map", (1, 2, 2.4853397382384474)), ("nested NESTED recursion", (2, 0, 1.4426950408889634)), (" ", (0, 0, 0.0)), (None, (0, 0, 0.0))]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.intent_features(F.col("t")).alias("f")).orderBy("i").collect()
    for r, (_, want) in zip(got, rows, strict=True):
        assert tuple(r["f"]) == pytest.approx(want)


CASES = [("null", 0.0), ("[]", 0.0), ('"[]"', 0.0), ('["PASS","bypass",null,1]', 0.5), ("\"['pass','fail']\"", 0.5), ('"[\\"pass\\", null]"', 1.0), ("\" ['pass']\"", 1.0), ('{"a":"pass"}', 0.0), ('"passed"', 1.0), ('"not passed"', 1.0), ("\"'pass'\"", 0.0), ("\"('pass',)\"", 0.0), ('"[\\"fail\\", null]"', 0.0), ('"1"', 0.0), ("true", 0.0)]


def test_pass_rates(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, s string").withColumn("v", F.parse_json("s"))
    got = [r[1] for r in df.select("i", status.variant_pass_rate(F.col("v"))).orderBy("i").collect()]
    assert got == [w for _, w in CASES]
    only_lists = [r[1] for r in df.select("i", status.variant_pass_rate(F.col("v"), "figure")).orderBy("i").collect()]
    assert only_lists == [0.5 if i == 3 else 0.0 for i in range(len(CASES))]
    with pytest.raises(ValueError):
        status.variant_pass_rate(F.col("v"), "other")


def test_code_metrics():
    assert code_metrics.measured("def f(x):\n    if x:\n        return 1\n    elif x > 2:\n        return 2\n    for i in x:\n        pass\n") == (3, 2, 1, 0)
    assert code_metrics.measured("") == (1, 0, 0, 0)
    assert code_metrics.measured("a = b and c or d") == (3, 0, 0, 0)
    assert code_metrics.measured("def broken(:\n    if x") == (2, 2, 1, 0)
    assert code_metrics.measured("async def f():\n    async for x in y:\n        pass") == (2, 2, 1, 0)


def test_plain_pass_rates_equal_the_literal_rule(spark):
    """Where built-in functions decide they agree with the parser, and they decide on plain lists."""
    rnd = random.Random(8)
    parts = ["'", '"', "[", "]", ",", " ", "\\", "\\'", "\\n", "pass", "PASS", "fail", "\n", "\t", "u", "b'", "\\x70", "None", "\x00", "é", "(", "#", "1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 9))) for _ in range(3_000)]
    items = ["'pass'", '"PASSED"', "'fail'", "'it\\'s a pass'", '"no\\npa\\nss"', "''", "'a, b]'", "'pa\\\\ss'", "'\\x70ass'", "u'pass'", "None", "'pass' 'x'"]
    texts += ["[" + ", ".join(rnd.choice(items) for _ in range(rnd.randrange(0, 5))) + rnd.choice(["", ",", " , "]) + "]" for _ in range(600)]
    texts += [" ['pass']", "\n['pass']", "['pass'] ", "['pass']\n", "['pass'", "[,]", "[ ]", "passed", "True", "not passed", "_pass_", "", "  ", "['" + "x" * 50_000 + "pass']", "[" + "'pass', 'no'," * 20_000 + "]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", status.plain_pass_rate(F.col("t")).alias("plain"), status.string_pass_rate("t").alias("rate")).collect()
    for r in rows:
        want = status.literal_pass_rate(texts[r.i])
        assert r.rate == want and r.plain in (None, want), texts[r.i][:80]
    decided = {texts[r.i] for r in rows if r.plain is not None}
    assert {" ['pass']", "['pass'] ", "[ ]", "passed", "True", texts[-1], texts[-2]} <= decided and "[u'pass']" not in decided
    assert "Python" not in df.select(status.plain_pass_rate(F.col("t")))._jdf.queryExecution().toString()


GOOD = [
    "def f(a, b):\n    for i in a:\n        if i and b:\n            return [x for x in b if x]\n    return None",
    "class A(B):\n    def g(self):\n        try:\n            self.x()\n        except (E, F):\n            pass\n        finally:\n            y = 1 if z else 2",
    "while a or b:\n    with c as d:\n        e = {k: v for k, v in d}\nelse:\n    f()",
    "if a:\n    b()\nelif c and d:\n    e()\nelse:\n    g()",
    "@dec\nasync def h():\n    async for q in r:\n        await q",
]
BROKEN = ["x = = 1", "d = )", "1 +", "return return", "y = 'open", "foo(a,", "%%%"]


@pytest.mark.parametrize("bad", BROKEN)
@pytest.mark.parametrize("good", GOOD)
def test_broken_lines_leave_the_rest_as_it_is(good, bad):
    """A broken statement before, after, and at the end of the innermost suite."""
    want = code_metrics.measured(good)
    deep = good + "\n" + " " * code_metrics.indent(good.split("\n")[-1]) + bad
    for code in (bad + "\n" + good, good + "\n" + bad, deep, bad + "\n\n# note\n" + good + "\n" + bad):
        assert code_metrics.measured(code) == want, code


def test_broken_headers_are_mended():
    whole = code_metrics.measured("def f(a):\n    if a and b:\n        while c(d):\n            pass\n    elif e:\n        pass\n    else:\n        g = [h for h in i]")
    for bad in (
        "def f(a\n    if a and b\n        while c(d:\n            pass\n    elif e\n        pass\n    else\n        g = [h for h in i",
        "def f(a:\n    if a and b:\n        while c(d)\n            pass\n    elif e:\n        pass\n    else:\n        g = [h for h in i]",
    ):
        assert code_metrics.measured(bad) == whole
    assert code_metrics.measured("try\n    a()\nexcept E\n    b()\n") == (2, 1, 0, 0)
    assert code_metrics.measured("class A\n    x = 1\n  y = 2\n") == (1, 1, 0, 1)
    assert code_metrics.measured("if x:\n\tif y\n\t\tz()") == (3, 2, 0, 0)
    for odd in ("\0", "    ", "\n\n", "(" * 5000, "if a:\n" * 300, "\n".join(" " * i + "if a" for i in range(400)), "\x0c\x1c:", "'" * 3, "\\"):
        assert code_metrics.measured(odd)[0] >= 1


def test_bins(spark):
    assert binning.equal_edges(0, 10, 5) == [-0.01, 2, 4, 6, 8, 10]
    assert binning.equal_edges(3, 3, 5) == pytest.approx([2.997, 2.9982, 2.9994, 3.0006, 3.0018, 3.003])
    assert binning.equal_edges(0, 0, 3)[0] == -0.001
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 10)] + [(None,), (float("nan"),)], "x double")
    got = binning.equal_width(df, "x", 5, "b").collect()
    assert [r["b"] for r in got] == [1, 1, 1, 2, 2, 5, None, None]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(binning.half_even(F.col("x"))).collect()] == [0, 2, 2]


def test_tails():
    assert probability.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert probability.chi2_tail(2 * math.log(20), 2) == pytest.approx(0.05)
    assert probability.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert probability.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_equal_snippets_and_lines_are_parsed_once(monkeypatch):
    """Repeated code costs one parse, at whatever depth it stands; long code is measured without being kept."""
    parses, plain = [], code_metrics.ast.parse
    monkeypatch.setattr(code_metrics.ast, "parse", lambda code: parses.append(code) or plain(code))
    body = "if q_1 and b\n    x = (1\n"
    once = code_metrics.measured(body + "y = = 1\n")
    first = len(parses)
    assert code_metrics.measured(body + "y = = 1\n") == once and len(parses) == first
    many = code_metrics.measured(body * 40 + "y = = 1\n")
    assert many == (1 + 40 * (once[0] - 1), *once[1:]) and len(parses) <= first + 3
    deep = code_metrics.measured("while (\n    " + body.replace("\n", "\n    ") + "\ny = = 1\n")
    assert deep[1] == once[1] + 1 and len(parses) <= first + 10
    long = body * 200 + "y = = 1\n"
    kept = code_metrics._measured_once.cache_info().currsize
    assert code_metrics.measured(long) == (1 + 200 * (once[0] - 1), *once[1:]) and code_metrics._measured_once.cache_info().currsize == kept


def test_rows_of_one_file_are_dealt_out(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert len({r[0] for r in scratch.spread(rows).select(F.spark_partition_id()).collect()}) >= spark.sparkContext.defaultParallelism


def test_fast_scans_equal_the_plain_patterns(spark):
    """Tests in front of a word and Python's splitting change no count, whatever stands around a word."""
    rnd = random.Random(5)
    parts = ["the", "THE", "ſet", "K", "Key", "İf", "ıf", "if", "set", "_", "é", "́", "‍", "-", "9", "'", *" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       　​﻿", "\U0001f600", "x"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for i in range(600)] + [(601, None), (602, ""), (603, "  ")]
    words = ("if", "set", "key", "the", "xi")
    slow = r"(?iU)\b(set|the|key|if|xi)\b"
    df = spark.createDataFrame(rows, "i int, t string").select("*", text.token_facts(F.col("t")).alias("f"), text.word_count(F.col("t"), words).alias("fast"), F.coalesce(F.regexp_count("t", F.lit(slow)), F.lit(0)).alias("plain"))
    seen = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(f"([^{text.WHITE}]+)"), F.lit(1))
    got = df.select("i", "f.*", "fast", "plain", F.size(seen).alias("n2"), F.size(F.array_distinct(seen)).alias("d2"), F.length(F.array_join(seen, "")).alias("c2")).collect()
    assert all((r.n, r.chars, r.different, r.fast) == (r.n2, r.c2, r.d2, r.plain) for r in got) and sum(r.plain for r in got) > 50
    assert len(text.word_pattern(words)) > len(slow) and text.word_pattern(("été",)).startswith("(?iU)")
