"""From feature tables to a model matrix: join, fill, encode, weight, split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.ordering import with_group_rank, with_position
from creditloom.session import side_by_side

LABEL = "default_flag"

# Feature lists of the two training profiles.
FULL_NUMERIC = [
    "loan_amount_inr",
    "annual_income_inr",
    "loan_term_months",
    "existing_loans",
    "collateral_coverage_ratio",
    "loan_to_income_ratio",
    "credit_score",
    "dti_ratio",
    "monthly_income_inr",
    "estimated_monthly_emi_inr",
    "bureau_monthly_burden_inr",
    "total_monthly_debt_inr",
    "delinquency_rate",
    "hard_inquiries_6m",
    "bureau_utilisation_pct",
    "avg_monthly_spend_inr",
    "spend_volatility_inr",
    "emi_payment_count_12m",
    "emi_regularity_score",
    "credit_stress_score",
    "flagged_txn_rate",
    "total_txns_12m",
]
FULL_CATEGORICAL = [
    "employment_type",
    "loan_purpose",
    "dti_risk_tier",
    "credit_risk_tier",
    "utilisation_band",
    "credit_age_band",
]
VERSIONED_NUMERIC = [
    "annual_income_inr",
    "loan_amount_inr",
    "loan_term_months",
    "credit_score",
    "loan_to_income_ratio",
    "collateral_coverage_ratio",
    "bureau_utilisation_pct",
    "emi_regularity_score",
    "credit_stress_score",
]
VERSIONED_CATEGORICAL = ["employment_type", "loan_purpose", "credit_risk_tier"]
MISSING_CATEGORY = "unknown"

# Columns taken from the application side and, with a default, from the customer side.
_APPLICATION_COLUMNS = [
    "application_id",
    "customer_id",
    "application_date",
    "loan_amount_inr",
    "annual_income_inr",
    "loan_term_months",
    "existing_loans",
    "collateral_coverage_ratio",
    "loan_to_income_ratio",
    "credit_score",
    "employment_type",
    "loan_purpose",
    "dti_ratio",
    "dti_risk_tier",
    "credit_risk_tier",
    "monthly_income_inr",
    "estimated_monthly_emi_inr",
    "bureau_monthly_burden_inr",
    "total_monthly_debt_inr",
    "delinquency_rate",
    "hard_inquiries_6m",
    "combined_risk_flag",
    "no_bureau_record_flag",
]
_CUSTOMER_ZERO = [
    "bureau_utilisation_pct",
    "avg_monthly_spend_inr",
    "spend_volatility_inr",
    "emi_payment_count_12m",
    "emi_regularity_score",
    "credit_stress_score",
    "flagged_txn_rate",
    "total_txns_12m",
    "balance_trend_flag",
    "utilisation_change_flag",
]
_CUSTOMER_UNKNOWN = ["utilisation_band", "credit_age_band"]

#: A categorical feature with more levels than this is a data error, not a feature.
MAX_LEVELS = 200


def scoring_frame(dti: DataFrame, util: DataFrame) -> DataFrame:
    """Every application with the behaviour features of its customer.

    ``util`` has one row per customer; pass it as a written table so that a customer with
    very many applications can be split (see ``session.write_stage``).
    """
    right = util.select(
        "customer_id",
        *[F.col(c).alias(f"_u_{c}") for c in (*_CUSTOMER_ZERO, *_CUSTOMER_UNKNOWN)],
    )
    zero = {c: F.lit(0).cast(util.schema[c].dataType) for c in _CUSTOMER_ZERO}
    default = {**zero, **{c: F.lit(MISSING_CATEGORY) for c in _CUSTOMER_UNKNOWN}}
    left = dti.select(*_APPLICATION_COLUMNS, LABEL)
    return left.join(right, "customer_id", "left").select(
        *_APPLICATION_COLUMNS,
        *[F.coalesce(f"_u_{c}", d).alias(c) for c, d in default.items()],
        LABEL,
    )


def training_frame(dti: DataFrame, util: DataFrame) -> DataFrame:
    """The labelled part of :func:`scoring_frame`; the filter runs before the join."""
    return scoring_frame(dti.where(F.col(LABEL).isNotNull()), util)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: how many values are missing.  One pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "feature", "null_count")


# --------------------------------------------------------------------------- medians

_SKETCH_ACCURACY = 10_000
#: Half the share of the values in the first bracket; the error of the sketch is a tenth of it.
_BRACKET = 0.001
#: Half widths of brackets that all folds share; the narrowest that is safe for the rows is taken.
_SHARED = [_BRACKET, 0.004, 0.02, 0.1]
#: Different values of a column that are brought to the driver at most.
_CELLS = 10_000


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact (interpolated) median of every column: rows (feature, median_value)."""
    found = medians_of(df, {c: F.col(c) for c in columns})
    return df.sparkSession.createDataFrame(
        list(found.items()), "feature string, median_value double"
    )


def fold_medians(folds: DataFrame, columns: Sequence[str], k: int) -> list[dict[str, float | None]]:
    """For each fold the medians of all rows outside it, for all folds and columns at once.

    Medians of folds dealt by chance lie close together, so a column has one bracket for all folds,
    and counts by fold give what is outside each.  Where they prove nothing (folds that go with the
    values, or too many values) the column takes the way of :func:`medians_of` fold by fold.
    """
    found = _shared_medians(folds, columns, k)
    left = {
        f"{i}|{c}": F.when(F.col("fold") != i, F.col(c))
        for i in range(k)
        for c in columns
        if (i, c) not in found
    }
    if left:
        for name, median in medians_of(folds, left).items():
            i, c = name.split("|", 1)
            found[int(i), c] = median
    return [{c: found[i, c] for c in columns} for i in range(k)]


def _shared_medians(
    folds: DataFrame, columns: Sequence[str], k: int
) -> dict[tuple[int, str], float | None]:
    """Medians outside each fold, as far as one bracket a column, narrowed once, proves them."""
    names = {f"m{i}": c for i, c in enumerate(columns)}
    numbers = folds.where(F.col("fold").isNotNull()).select(
        "fold", *[F.col(c).cast("double").alias(m) for m, c in names.items()]
    )
    around = [0.5 + sign * h for h in _SHARED for sign in (-1, 1)]
    row = numbers.agg(
        *[F.count(m).alias(f"n_{m}") for m in names],
        *[F.percentile_approx(m, around, _SKETCH_ACCURACY).alias(m) for m in names],
    ).first()
    found: dict[tuple[int, str], float | None] = {}
    bracket = {}
    for m, c in names.items():
        if not row[f"n_{m}"]:
            found |= {(i, c): None for i in range(k)}
            continue
        # five standard deviations of the middle of half the rows, and the error of the sketch
        safe = 2.5 / row[f"n_{m}"] ** 0.5 + 2 / _SKETCH_ACCURACY
        at = next((2 * j for j, h in enumerate(_SHARED) if h >= safe), None)
        limits = row[m][at : at + 2] if at is not None else (float("-inf"), float("inf"))
        bracket[m] = tuple(limits)
    for narrowed in (False, True):
        if not bracket:
            break
        counts, cells = side_by_side(
            lambda: _fold_counts(numbers, bracket), lambda: _fold_cells(numbers, bracket, k)
        )
        if cells is None:
            if narrowed:
                break
            bracket = _narrower_for_folds(numbers, bracket, counts, k)
            continue
        for m in bracket:
            for i in range(k):
                n, below, inside = _outside(counts, m, i)
                first, last = (n + 1) // 2, (n + 2) // 2
                if not n:
                    found[i, names[m]] = None
                elif below < first <= last <= below + inside:
                    upto, middle = below, []
                    for value, by_fold in sorted(cells.get(m, {}).items()):
                        here = sum(x for fold, x in by_fold.items() if fold != i)
                        middle += [value for rank in (first, last) if upto < rank <= upto + here]
                        upto += here
                    found[i, names[m]] = sum(middle) / 2
        break
    return found


def _outside(counts: Mapping, m: str, i: int) -> tuple[int, int, int]:
    """Values, those below and those inside the bracket of a column in all folds but one."""
    rows = [r for fold, r in counts.items() if fold != i]
    return tuple(sum(r[f"{kind}_{m}"] for r in rows) for kind in "nbi")


def _fold_counts(numbers: DataFrame, bracket: Mapping[str, tuple[float, float]]) -> dict:
    """Values of each fold, and how many lie below and inside the bracket of each column."""
    rows = numbers.groupBy("fold").agg(
        *[F.count(m).alias(f"n_{m}") for m in bracket],
        *[F.count_if(F.col(m) < lo).alias(f"b_{m}") for m, (lo, _) in bracket.items()],
        *[F.count_if(F.col(m).between(*limits)).alias(f"i_{m}") for m, limits in bracket.items()],
    )
    return {r["fold"]: r for r in rows.collect()}  # one row per fold


def _fold_cells(
    numbers: DataFrame, bracket: Mapping[str, tuple[float, float]], k: int
) -> dict[str, dict[float, dict[int, int]]] | None:
    """How often each value inside the brackets occurs in each fold; None if there are too many."""
    inside = [
        F.when(F.col(m).between(*limits), F.struct(F.lit(m).alias("m"), F.col(m).alias("value")))
        for m, limits in bracket.items()
    ]
    rows = (
        numbers.select("fold", F.explode(F.array_compact(F.array(*inside))).alias("cell"))
        .groupBy("fold", "cell.m", "cell.value")
        .count()
        .take(_CELLS * len(bracket) * k + 1)
    )
    if len(rows) > _CELLS * len(bracket) * k:
        return None
    out: dict[str, dict[float, dict[int, int]]] = {}
    for fold, m, value, n in rows:
        out.setdefault(m, {}).setdefault(value, {})[fold] = n
    return out


def _narrower_for_folds(
    numbers: DataFrame, bracket: Mapping[str, tuple[float, float]], counts: Mapping, k: int
) -> dict[str, tuple[float, float]]:
    """Brackets within the brackets that hold the middles outside every fold, by another sketch."""
    sketches = []
    for m, limits in bracket.items():
        shares = []
        for n, below, inside in (_outside(counts, m, i) for i in range(k)):
            if inside:
                shares += [((n + 1) // 2 - below) / inside, ((n + 2) // 2 - below) / inside]
        margin = 10 / _SKETCH_ACCURACY + 2.5 / max(1, _outside(counts, m, -1)[2]) ** 0.5
        shares = shares or [0.0, 1.0]
        wanted = [min(max(x, 0.0), 1.0) for x in (min(shares) - margin, max(shares) + margin)]
        within = F.when(F.col(m).between(*limits), F.col(m))
        sketches.append(F.percentile_approx(within, wanted, _SKETCH_ACCURACY).alias(m))
    row = numbers.agg(*sketches).first()
    return {m: tuple(row[m]) if row[m] else (float("-inf"), float("inf")) for m in bracket}


def medians_of(df: DataFrame, values: Mapping[str, Column]) -> dict[str, float | None]:
    """Exact (interpolated) medians of expressions over the rows; None where all are null.

    Bracketed selection, for all expressions in the same passes.  A quantile sketch gives a narrow
    bracket around each median.  The values inside are counted by value, and how many lie below
    proves that the middle ones are inside; where that proof fails the bracket is opened.  Where
    more than ``_CELLS`` different values are inside, a sketch of these gives a narrower bracket.
    Every pass sums up before anything is sent, so there is no shuffle of rows.
    """
    names = {f"m{i}": name for i, name in enumerate(values)}
    numbers = df.select(*[v.cast("double").alias(m) for m, v in zip(names, values.values())])
    around = [0.5 - _BRACKET, 0.5 + _BRACKET]
    row = numbers.agg(
        *[F.count(m).alias(f"n_{m}") for m in names],
        *[F.percentile_approx(m, around, _SKETCH_ACCURACY).alias(m) for m in names],
    ).first()
    sizes = {m: row[f"n_{m}"] for m in names}
    bracket = {m: tuple(row[m]) for m in names if sizes[m]}
    found: dict[str, float | None] = dict.fromkeys(names)
    while bracket:
        (below, inside), cells = side_by_side(
            lambda: _bracket_counts(numbers, bracket), lambda: _cells(numbers, bracket)
        )
        if cells is None:
            bracket = _narrower(numbers, bracket, sizes, below, inside)
            continue
        opened = {}
        for m in bracket:
            first, last = (sizes[m] + 1) // 2, (sizes[m] + 2) // 2
            if not below[m] < first <= last <= below[m] + inside[m]:
                opened[m] = (float("-inf"), float("inf"))
                continue
            upto, middle = below[m], []
            for value, n in sorted(cells.get(m, ())):
                middle += [value for rank in (first, last) if upto < rank <= upto + n]
                upto += n
            found[m] = sum(middle) / 2
        bracket = opened
    return {name: found[m] for m, name in names.items()}


def _cells(
    numbers: DataFrame, bracket: Mapping[str, tuple[float, float]]
) -> dict[str, list[tuple[float, int]]] | None:
    """How often each value inside the brackets occurs; None if there are too many values."""
    inside = [
        F.when(F.col(m).between(*limits), F.struct(F.lit(m).alias("m"), F.col(m).alias("value")))
        for m, limits in bracket.items()
    ]
    rows = (
        numbers.select(F.explode(F.array_compact(F.array(*inside))).alias("cell"))
        .groupBy("cell.m", "cell.value")
        .count()
        .take(_CELLS * len(bracket) + 1)
    )
    if len(rows) > _CELLS * len(bracket):
        return None
    out: dict[str, list[tuple[float, int]]] = {}
    for m, value, n in rows:
        out.setdefault(m, []).append((value, n))
    return out


def _narrower(
    numbers: DataFrame,
    bracket: Mapping[str, tuple[float, float]],
    sizes: Mapping[str, int],
    below: Mapping[str, int],
    inside: Mapping[str, int],
) -> dict[str, tuple[float, float]]:
    """Brackets within the brackets, by a sketch of the values inside."""
    margin = max(_BRACKET, 10 / _SKETCH_ACCURACY)
    sketches = []
    for m, limits in bracket.items():
        n = max(inside[m], 1)
        lo = ((sizes[m] + 1) // 2 - below[m]) / n - margin
        hi = ((sizes[m] + 2) // 2 - below[m]) / n + margin
        share = [min(max(x, 0.0), 1.0) for x in (lo, hi)]
        within = F.when(F.col(m).between(*limits), F.col(m))
        sketches.append(F.percentile_approx(within, share, _SKETCH_ACCURACY).alias(m))
    row = numbers.agg(*sketches).first()
    return {m: tuple(row[m]) if row[m] else (float("-inf"), float("inf")) for m in bracket}


def _bracket_counts(
    numbers: DataFrame, bracket: Mapping[str, tuple[float, float]]
) -> tuple[dict[str, int], dict[str, int]]:
    """How many values lie below and inside the bracket of each column; one pass."""
    row = numbers.agg(
        *[F.count_if(F.col(c) < lo).alias(f"b_{c}") for c, (lo, _) in bracket.items()],
        *[F.count_if(F.col(c).between(lo, hi)).alias(f"i_{c}") for c, (lo, hi) in bracket.items()],
    ).first()
    return {c: row[f"b_{c}"] for c in bracket}, {c: row[f"i_{c}"] for c in bracket}


# --------------------------------------------------------------------------- encoding


@dataclass
class FeatureSpec:
    """What was learnt from the training rows: medians, category levels, column order."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        dummies = [f"{c}_{level}" for c in self.categorical for level in self.levels[c]]
        return [*self.numeric, *dummies]


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Alphabetical levels of each category column, missing values counted as ``unknown``.

    One pass for all columns.  ``take`` with one row over the bound keeps the result small
    even when a column is dirty.
    """
    cells = [
        F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)).alias("level"))
        for c in columns
    ]
    pairs = df.select(F.inline(F.array(*cells))).distinct()
    rows = pairs.take(MAX_LEVELS * len(columns) + 1)
    out = {c: sorted(r["level"] for r in rows if r["name"] == c) for c in columns}
    for c, found in out.items():
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
    return out


def fit_features(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> FeatureSpec:
    """Learn medians and category levels; call it on the training rows only."""
    medians, levels = side_by_side(
        lambda: medians_of(df, {c: F.col(c) for c in numeric}),
        lambda: category_levels(df, categorical),
    )
    return FeatureSpec(list(numeric), list(categorical), medians, levels)


def fit_fold_features(
    folds: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int
) -> list[FeatureSpec]:
    """For each fold what is learnt from the rows outside it; the table is read for all at once."""
    cells = [
        F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)).alias("level"))
        for c in categorical
    ]
    medians, rows = side_by_side(
        lambda: fold_medians(folds, numeric, k),
        lambda: folds.select("fold", F.inline(F.array(*cells))).distinct().take(
            MAX_LEVELS * k * len(categorical) + 1
        )
        if cells
        else [],
    )
    specs = []
    for i in range(k):
        seen = {c: set() for c in categorical}
        for r in rows:
            if r["fold"] != i:
                seen[r["name"]].add(r["level"])
        for c, found in seen.items():
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        levels = {c: sorted(found) for c, found in seen.items()}
        specs.append(FeatureSpec(list(numeric), list(categorical), medians[i], levels))
    return specs

def impute(df: DataFrame, medians: Mapping[str, float], categorical: Sequence[str]) -> DataFrame:
    """Fill numbers with the fitted median and categories with ``unknown``."""
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in medians.items()
    }
    filled |= {c: F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)) for c in categorical}
    return df.withColumns(filled)


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one 0/1 column per level; an unseen level gives zeros in all of them."""
    return df.withColumns(
        {
            f"{c}_{level}": F.when(F.col(c) == level, 1).otherwise(0)
            for c, names in levels.items()
            for level in names
        }
    )


def align(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` as doubles, in that order; absent columns and NULLs become 0."""
    present = set(df.columns)
    values = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        if c in present
        else F.lit(0.0).alias(c)
        for c in columns
    ]
    return df.select(*keep, *values)


def encode(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Apply a fitted spec: fill, one-hot, align."""
    filled = impute(df, spec.medians, spec.categorical)
    return align(one_hot(filled, spec.levels), spec.columns, keep)


# --------------------------------------------------------------------------- weights, splits


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced class weight n / (classes * n_class); one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.agg(  # one entry per class
        F.collect_list(F.struct(label, "n")).alias("_classes"), F.sum("n").alias("_all")
    )
    rows = classes.select("_all", F.size("_classes").alias("_k"), F.inline("_classes"))
    return rows.select(
        label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("class_weight")
    )


def class_weight(counts: Mapping, label: str = LABEL) -> Column:
    """Weight column for known class sizes; a label has a handful of classes."""
    total = sum(counts.values())
    return F.coalesce(
        *[
            F.when(F.col(label) == value, total / (len(counts) * n))
            for value, n in counts.items()
        ]
    )


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    """Rows per class; more than ``MAX_LEVELS`` classes are an error."""
    rows = df.groupBy(label).count().take(MAX_LEVELS + 1)
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{label} has more than {MAX_LEVELS} classes")
    return {r[label]: r["count"] for r in rows}


def time_split(
    df: DataFrame,
    date: str = "application_date",
    key: str = "application_id",
    train_share: float = 0.8,
) -> DataFrame:
    """Add ``split``: the earliest ``floor(train_share * n)`` rows are ``train``.

    Rows are ordered by date, then by the unique ``key``; undated rows come last.  Day counts
    show on which day the cut falls, and only the keys of that day are put in order to find
    the last training row.  The split itself is then a plain column expression.
    """
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(date).asc_nulls_last())
    counts = days.collect()  # one row per calendar day
    cut, seen = int(sum(r["n"] for r in counts) * train_share), 0
    for r in counts:
        if seen + r["n"] > cut:
            break
        seen += r["n"]
    else:
        return df.withColumn("split", F.lit("train"))
    if r[date] is None:
        on_day, earlier = F.col(date).isNull(), F.col(date).isNotNull()
    else:
        on_day = F.col(date).eqNullSafe(F.lit(r[date]))
        earlier = F.coalesce(F.col(date) < F.lit(r[date]), F.lit(False))
    is_train = earlier
    if cut > seen:
        last_key = _nth_key(df.where(on_day).select(key), key, cut - seen)
        is_train = earlier | (on_day & (F.col(key) <= F.lit(last_key)))
    return df.withColumn("split", F.when(is_train, "train").otherwise("test"))


def _nth_key(keys: DataFrame, key: str, n: int):
    """The n-th smallest of the unique keys."""
    placed = with_position(keys, [F.col(key)], "_place")
    return placed.where(F.col("_place") == n).first()[key]


def cv_folds(
    df: DataFrame,
    k: int = 5,
    label: str = LABEL,
    key: str = "application_id",
    seed: int = 42,
) -> DataFrame:
    """Add ``fold``: every class is dealt out evenly over ``k`` folds in hashed order.

    A class holds a large part of the table, so the rank inside a class is taken over sorted
    blocks and not in one window partition.
    """
    shuffled = F.sha2(F.concat(F.col(key), F.lit(f"#{seed}")), 256)
    ranked = with_group_rank(
        df.withColumn("_shuffled", shuffled), [label], [F.col("_shuffled"), F.col(key)], "_rank"
    )
    fold = ((F.col("_rank") - 1) % k).cast(T.IntegerType())
    return ranked.withColumn("fold", fold).drop("_rank", "_shuffled")
