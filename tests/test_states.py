"""Tables that change: updates of two writers, states of landings, days of other types."""

import datetime as dt
from functools import reduce

import pytest
from pyspark.sql import functions as F

from creditloom.operators import features, monthly_state
from creditloom.operators.latest import upsert
from creditloom.plans import pipeline
from creditloom.plans.given_lake import lake
from creditloom.sources import landing, snapshots


def test_no_update_of_two_writers_is_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")
    snapshots.replace_part(rows(1), path)
    met = []

    def slow(old):
        merged = upsert(old, rows(10), ["id"])
        if not met:  # while the first writer works, a second one comes and goes
            met.append(1)
            snapshots.update_part(spark, path, lambda now: upsert(now, rows(20), ["id"]))
        return merged

    snapshots.update_part(spark, path, slow)
    assert sorted(r.id for r in snapshots.read_parts(spark, path).collect()) == [1, 10, 20]

    def always_late(old):
        snapshots.update_part(spark, path, lambda now: now)
        return old

    with pytest.raises(RuntimeError):
        snapshots.update_part(spark, path, always_late, attempts=2)
    assert snapshots.read_parts(spark, path).count() == 3


def test_a_writer_that_dies_between_number_and_content(spark, tmp_path):
    path = tmp_path / "t"
    snapshots.replace_part(spark.range(3), str(path))
    (path / "_current" / "000000000002@all").write_text("")
    assert snapshots.read_parts(spark, str(path)).count() == 3
    snapshots.update_part(spark, str(path), lambda old: old.where("id > 0"))
    assert snapshots.read_parts(spark, str(path)).count() == 2


def test_silver_stays_when_its_build_dies(spark, tmp_path, sf, monkeypatch):
    given, paths, day = lake(spark, sf).silver, pipeline.LakePaths(str(tmp_path)), dt.date(2001, 8, 1)
    for name, rows in (
        ("loan_applications", given.bronze_loans),
        ("credit_bureau", given.bronze_bureau),
        ("transactions", given.bronze_transactions),
    ):
        landing.write_bronze(rows, paths.bronze, name, day)
    pipeline.build_silver(spark, paths, given.as_of, day)
    tables = ("stg_loans", "feat_credit_util")
    before = {t: snapshots.known_table(spark, f"{paths.silver}/{t}").count() for t in tables}
    boom = F.raise_error(F.lit("lost")).cast("double")
    monkeypatch.setattr(
        features, "feat_credit_util", lambda credit, agg: credit.withColumn("broken", boom)
    )
    with pytest.raises(Exception, match="lost"):
        pipeline.build_silver(spark, paths, given.as_of, day)
    monkeypatch.undo()
    after = {t: snapshots.known_table(spark, f"{paths.silver}/{t}").count() for t in tables}
    assert after == before and "broken" not in snapshots.known_table(
        spark, f"{paths.silver}/feat_credit_util"
    ).columns


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns) and dict(a.dtypes) == dict(b.dtypes)
    return sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))


def test_states_of_landings_equal_a_rebuild(spark, tmp_path, sf):
    """Three landings, one of them late and one repeated with other rows."""
    rows, as_of = lake(spark, sf).silver.bronze_transactions, lake(spark, sf).as_of
    old = F.col("transaction_date") < F.date_sub(F.lit(as_of), 100)
    odd = F.pmod(F.hash("transaction_id"), F.lit(2)) == 1
    landings = [rows.where(~old), rows.where(old & odd), rows.where(old & ~odd)]
    path = str(tmp_path / "state")
    monthly_state.keep_state(landings[0], path, dt.date(2001, 7, 1))
    monthly_state.keep_state(rows, path, dt.date(2001, 7, 2))  # wrong, landed again below
    monthly_state.keep_state(landings[2], path, dt.date(2001, 7, 3))
    monthly_state.keep_state(landings[1], path, dt.date(2001, 7, 2))
    states = monthly_state.kept_states(spark, path)
    assert same(
        monthly_state.spend_of_states(states, as_of), features.monthly_spend(rows, as_of)
    )
    assert same(
        monthly_state.spend_of_states(monthly_state.merged(states), as_of),
        features.monthly_spend(rows, as_of),
    )
    with pytest.raises(LookupError):
        monthly_state.kept_states(spark, str(tmp_path / "nothing"))


def test_states_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [
            ("a", dt.date(2001, 7, 1), None, "POS ", None, None),
            ("a", dt.date(2001, 7, 2), 5, None, 7, 1),
            ("a", dt.date(2000, 1, 1), 5, "debit", 7, 1),
            (None, dt.date(2001, 7, 2), 5, "debit", 7, 1),
            ("b", None, 5, "debit", 7, 1),
            ("b", dt.date(2001, 7, 9), 3, "emi_payment", None, 0),
        ],
        "customer_id string, transaction_date date, amount_inr bigint, transaction_type string, "
        "balance_after_inr bigint, is_flagged bigint",
    )
    as_of = dt.date(2001, 7, 31)
    states = monthly_state.day_state(rows)
    assert same(monthly_state.spend_of_states(states, as_of), features.monthly_spend(rows, as_of))


def test_increments_read_only_the_new_day(spark, tmp_path, sf, monkeypatch):
    given, paths = lake(spark, sf).silver, pipeline.LakePaths(str(tmp_path))
    monkeypatch.setitem(landing.LANDING, "transactions", landing.INCREMENT)
    days = [dt.date(2001, 7, 30), dt.date(2001, 7, 31)]
    half = F.pmod(F.hash("transaction_id"), F.lit(2))
    read = []
    plain = landing.read_bronze
    monkeypatch.setattr(
        landing, "read_bronze", lambda s, b, name, day=None: read.append((name, day)) or plain(s, b, name, day)
    )
    for n, day in enumerate(days):
        landing.write_bronze(given.bronze_loans, paths.bronze, "loan_applications", day)
        landing.write_bronze(given.bronze_bureau, paths.bronze, "credit_bureau", day)
        landing.write_bronze(given.bronze_transactions.where(half == n), paths.bronze, "transactions", day)
        pipeline.build_silver(spark, paths, given.as_of, day)
    drop = ["silver_processed_at", "feature_computed_at"]
    built = snapshots.known_table(spark, f"{paths.silver}/feat_credit_util").drop(*drop)
    assert same(built, given.feat_credit_util.drop(*drop))


DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]


def land(spark, base, frames):
    for day, df in zip(DAYS, frames):
        landing.write_bronze(df, base, "s", day)


def test_history_of_a_column_that_changed_its_type(spark, tmp_path):
    base = str(tmp_path)
    frames = [
        spark.createDataFrame([(1, 10, dt.date(2024, 5, 1))], "id int, x int, d date"),
        spark.createDataFrame([(2, "n/a", "later")], "id bigint, x string, new string"),
        spark.createDataFrame([(3, 2.5)], "id int, x double"),
        spark.createDataFrame([(4, 7, dt.datetime(2024, 6, 1, 12))], "id int, x int, d timestamp"),
    ]
    land(spark, base, frames)
    history = landing.read_bronze(spark, base, "s")
    assert dict(history.dtypes) == {"id": "bigint", "x": "string", "d": "timestamp", "new": "string"}
    got = {r.id: (r.x, r.d, r.new) for r in history.collect()}
    assert got == {
        1: ("10", dt.datetime(2024, 5, 1), None),
        2: ("n/a", None, "later"),
        3: ("2.5", None, None),
        4: ("7", dt.datetime(2024, 6, 1, 12), None),
    }
    types = {(r.column_name, r.type): (r.days, r.first_day, r.read_as) for r in landing.landed_types(spark, base, "s").collect()}
    assert types["x", "int"] == (2, "2024-01-01", "string")
    assert types["id", "bigint"] == (1, "2024-01-02", "bigint")
    assert landing.read_bronze(spark, base, "s", DAYS[2]).dtypes == [("id", "int"), ("x", "double")]


@pytest.mark.parametrize(
    "types,want",
    [
        (["int"], "int"),
        (["int", "bigint"], "bigint"),
        (["int", "double", "bigint"], "double"),
        (["float", "int"], "double"),
        (["date", "timestamp"], "timestamp"),
        (["date", "int"], "string"),
        (["boolean", "int"], "string"),
        (["array<int>", "int"], "string"),
    ],
)
def test_widest_type(types, want):
    assert landing.widest(types) == want
    assert landing.widest(types[::-1]) == want
