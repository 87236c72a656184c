"""Bronze-shaped DataFrames derived from the given parquet tables.

The given tables are an order/customer star schema.  Orders stand in for loan applications,
yearly order histories for bureau pulls and line items for card and account transactions.
The same arithmetic is restated in SQL in ``oracle/given_tables.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Date up to which the given transactions count as known.
AS_OF = dt.date(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_key(key: Column) -> Column:
    return F.concat(F.lit("CUST"), F.lpad(key.cast("string"), 12, "0"))


def application_key(key: Column) -> Column:
    return F.concat(F.lit("APP"), F.lpad(key.cast("string"), 12, "0"))


def _rupees(amount: Column) -> Column:
    return F.floor(amount).cast("bigint")


def _text(value: Column) -> Column:
    return value.cast("string")


def _lookup(value: Column, pairs: dict, otherwise: str) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in pairs.items()], F.lit(otherwise))


def bronze_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    price, balance = F.col("o_totalprice"), F.col("c_acctbal")
    score = F.lit(300) + (order * 7919 + cust * 104729) % 600
    risky = (score < 550) | ((balance > 0) & (price > F.lit(4) * balance * 60))
    return df.select(
        F.concat(F.lit(" "), application_key(order)).alias("application_id"),
        F.concat(customer_key(cust), F.lit(" ")).alias("customer_id"),
        _text(F.col("o_orderdate").cast("date")).alias("application_date"),
        _text(_rupees(price)).alias("loan_amount_inr"),
        _lookup(
            F.substring("o_orderpriority", 1, 1),
            {"1": "12", "2": "24", "3": "36", "4": "60"},
            "84",
        ).alias("loan_term_months"),
        _text(_rupees(balance * 60)).alias("annual_income_inr"),
        _lookup(
            F.col("c_mktsegment"),
            {
                "BUILDING": " Salaried",
                "MACHINERY": "SELF_EMPLOYED",
                "AUTOMOBILE": "contract",
                "FURNITURE": "Unemployed ",
            },
            "salaried",
        ).alias("employment_type"),
        _lookup(
            order % 5,
            {0: "home_purchase", 1: "Refinance", 2: "auto", 3: "PERSONAL"},
            "business",
        ).alias("loan_purpose"),
        _text(cust % 6).alias("existing_loans"),
        _text(score).alias("credit_score"),
        _text(_rupees(price) * (order % 25)).alias("collateral_value"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
        .when(risky, F.lit("1"))
        .otherwise(F.lit("0"))
        .alias("default_flag"),
    )


def bronze_bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_custkey") % 11 != 0)
    amount = F.floor("o_totalprice")
    is_open = F.col("o_orderstatus") == "O"
    late = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") < "3")
    pulls = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("pulled"),
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(is_open).alias("opened"),
        F.count_if(late).alias("late"),
        F.sum(amount).cast("bigint").alias("limit"),
        F.sum(F.when(is_open, amount).otherwise(0)).cast("bigint").alias("balance"),
    )
    cust, year = F.col("o_custkey"), F.col("y")
    return pulls.select(
        customer_key(cust).alias("customer_id"),
        _text(F.col("pulled")).alias("bureau_pull_date"),
        _text(F.lit(300) + (cust * 104729 + year) % 600).alias("credit_score"),
        _text(F.col("accounts")).alias("total_accounts"),
        _text(F.col("opened")).alias("open_accounts"),
        _text(F.col("late")).alias("delinquent_accounts"),
        (((cust * 997 + year) % 130 - 10).cast("double") / 100).alias("credit_utilisation_pct"),
        _text(cust * 13 % 240).alias("oldest_account_months"),
        _text((cust * 31 + year) % 7).alias("hard_inquiries_6m"),
        _text(F.col("limit")).alias("total_credit_limit_inr"),
        _text(F.col("balance")).alias("total_balance_inr"),
    )


def bronze_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return df.select(
        F.concat(F.lit("TXN"), _text(order), F.lit("-"), _text(line)).alias("transaction_id"),
        customer_key(F.col("o_custkey")).alias("customer_id"),
        _text(F.col("l_shipdate").cast("date")).alias("transaction_date"),
        _text(_rupees(F.col("l_extendedprice"))).alias("amount_inr"),
        _lookup(
            (order + line) % 6,
            {0: "debit", 1: "credit", 2: "transfer", 3: "EMI_Payment ", 4: "atm_withdrawal"},
            "pos",
        ).alias("transaction_type"),
        _text((order * 7919 + line * 31) % 2000000).alias("balance_after_inr"),
        F.when((order * 13 + line) % 33 == 0, "1").otherwise("0").alias("is_flagged"),
    )


def surrogate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the shape of the predictions table, reproducible in any SQL engine.

    Every order is scored one to three times: version ``v0`` on its order date, later
    versions one day apart.
    """
    from creditloom.functions import bands

    order, cust, version = F.col("o_orderkey"), F.col("o_custkey"), F.col("v")
    scored = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("day"),
        F.explode(F.sequence(F.lit(0), (order % 3).cast("int"))).alias("v"),
    )
    rf = ((order * 7919 + cust * 31 + version * 613) % 10000).cast("double") / 10000
    lr = ((order * 104729 + cust * 17 + version * 271) % 10000).cast("double") / 10000
    ens = F.round(rf * 0.7 + lr * 0.3, 6)
    return scored.select(
        application_key(order).alias("application_id"),
        customer_key(cust).alias("customer_id"),
        rf.alias("pd_probability_rf"),
        lr.alias("pd_probability_lr"),
        ens.alias("pd_probability_ens"),
        bands.flag(ens >= 0.5).alias("pd_prediction"),
        bands.risk_grade(ens).alias("risk_grade"),
        F.concat(F.lit("v"), _text(version)).alias("model_version"),
        F.date_add("day", version).cast("timestamp_ntz").alias("scored_at"),
    )
