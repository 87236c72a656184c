"""Bands just below, at and above each bound, and for NULL."""

import random

import pytest
from pyspark.sql import functions as F

from creditloom.functions import bands
from creditloom.functions.numbers import clamp, ratio, round_binary
from creditloom.functions.text import fixed, percent, section_name, signed, strip

CASES = [
    (bands.credit_tier, [(449, "very_high"), (450, "high"), (599, "high"), (600, "medium"),
                         (749, "medium"), (750, "low"), (None, "very_high")]),
    (bands.utilisation_band, [(-0.1, "low"), (0.2999, "low"), (0.30, "medium"), (0.5999, "medium"),
                              (0.60, "high"), (0.8999, "high"), (0.90, "maxed_out"),
                              (None, "maxed_out")]),
    (bands.credit_age_band, [(11, "new"), (12, "developing"), (35, "developing"),
                             (36, "established"), (83, "established"), (84, "mature"),
                             (None, "mature")]),
    (bands.dti_tier, [(0.3599, "low"), (0.36, "moderate"), (0.4299, "moderate"),
                      (0.43, "elevated"), (0.4999, "elevated"), (0.50, "high"),
                      (None, "unknown")]),
    (bands.risk_grade, [(0.0, "A"), (0.0499, "A"), (0.05, "B"), (0.1499, "B"), (0.15, "C"),
                        (0.2999, "C"), (0.30, "D"), (0.4999, "D"), (0.50, "E"), (1.0, "E")]),
    (bands.pd_label, [(0.2999, "LOW"), (0.30, "MEDIUM"), (0.4999, "MEDIUM"), (0.50, "HIGH"),
                      (0.6999, "HIGH"), (0.70, "VERY HIGH"), (None, "LOW")]),
]


@pytest.mark.parametrize("rule,pairs", CASES, ids=[c[0].__name__ for c in CASES])
def test_bounds(spark, rule, pairs):
    rows = [(None if v is None else float(v), want) for v, want in pairs]
    df = spark.createDataFrame(rows, "v double, want string")
    bad = df.withColumn("got", rule(F.col("v"))).where("got <> want").collect()
    assert bad == []


@pytest.mark.parametrize(
    "d,p,want",
    [(0.3, 0.051, "none"), (0.049, 0.01, "none"), (0.05, 0.05, "minor"), (0.0999, 0.01, "minor"),
     (0.10, 0.01, "moderate"), (0.1999, 0.01, "moderate"), (0.20, 0.01, "severe")],
)
def test_drift_severity(spark, d, p, want):
    got = spark.range(1).select(bands.drift_severity(F.lit(d), F.lit(p))).first()[0]
    assert got == want


def test_guarded_numbers(spark):
    one = spark.range(1)
    null = F.lit(None).cast("double")
    row = one.select(
        ratio(F.lit(1), F.lit(3)),
        ratio(F.lit(1), F.lit(0)),
        clamp(F.lit(-0.1), 0.0, 1.0),
        clamp(F.lit(1.2), 0.0, 1.0),
        clamp(null, 0.0, 1.0),
    ).first()
    assert tuple(row) == (0.3333, None, 0.0, 1.0, 1.0)


def test_numbers_are_formatted_like_python(spark):
    values = [0.735, 0.125, 2.675, 1234.5, -0.00004, 0.0, 99.95, 1e7, -3.14159]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    rows = df.select("v", fixed(v, 2), fixed(v, 0), percent(v), signed(v), round_binary(v, 2))
    for x, two, none, pct, sign, rounded in rows.collect():
        assert two == f"{x:.2f}"
        assert none == f"{x:.0f}"
        assert pct == f"{x:.1%}"
        assert sign == f"{x:+.4f}"
        assert rounded == round(x, 2)


def test_numbers_of_all_sizes_are_rounded_as_they_are_formatted(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 14) for _ in range(2000)]
    values += [(2 * n + 1) / 2**k for n in range(-40, 40) for k in (1, 3, 5)]
    values += [n / 10**5 + e for n in range(5, 2000, 10) for e in (0.0, 1e-17, -1e-17)]
    values += [0.00005, 2.5e15 + 0.5, 1e300, 4503599627370497.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    for d in (4, 5, 6):
        rows = df.select("v", round_binary(v, d), fixed(v, d).cast("double")).collect()
        assert [r for r in rows if repr(r[1]) != repr(r[2])] == []
    plain = df.select(round_binary(F.col("v"), 4).alias("r"))
    assert "rint" in plain._jdf.queryExecution().optimizedPlan().toString().lower()
    assert spark.range(1).select(round_binary(F.lit(None), 4)).first()[0] is None


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("\n\t a b \r\n",), ("SECTION 12:  Loan Limits  \nrest",), ("no heading",)], "t string"
    )
    rows = df.select(strip(F.col("t")), section_name(F.col("t"))).collect()
    assert rows[0][0] == "a b"
    assert [r[1] for r in rows] == ["general", "loan limits", "general"]
