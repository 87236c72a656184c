"""Model registry: one small row per model version, changed by whole-table transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.latest import upsert

# The states of a version and the acceptance threshold.
CANDIDATE, ACTIVE, RETIRED = "candidate", "active", "retired"
MIN_AUC = 0.70

REGISTRY_SCHEMA = (
    "model_version string, rf_auc double, lr_auc double, ensemble_auc double, "
    "avg_precision double, feature_count int, train_rows bigint, test_rows bigint, "
    "status string, trained_at timestamp, registered_at timestamp, notes string"
)
#: What registering a known version again replaces.
REREGISTER_UPDATES = ["ensemble_auc", "status", "registered_at"]


class ModelRejected(ValueError):
    """The model did not reach the acceptance threshold."""


def gate(ensemble_auc: float | None, threshold: float = MIN_AUC) -> None:
    if ensemble_auc is None or ensemble_auc < threshold:
        raise ModelRejected(f"ensemble AUC {ensemble_auc} is below {threshold}")


def _retire_active(registry: DataFrame) -> DataFrame:
    retired = F.when(F.col("status") == ACTIVE, RETIRED).otherwise(F.col("status"))
    return registry.withColumn("status", retired)


def register(registry: DataFrame, model: DataFrame, promote: bool = False) -> DataFrame:
    """The registry after adding a one-row ``model`` (all columns but status).

    The first model becomes active.  Later ones stay candidates unless ``promote`` is set and
    their AUC beats the newest active one, which is then retired.
    """
    is_active = F.col("status") == ACTIVE
    held = registry.agg(
        F.count_if(is_active).alias("n"),
        F.max_by("ensemble_auc", F.when(is_active, F.col("registered_at"))).alias("auc"),
    ).first()
    auc = model.select("ensemble_auc").first()[0]
    if held["n"] == 0:
        status = ACTIVE
    elif promote and auc is not None and auc > (held["auc"] or 0.0):
        status, registry = ACTIVE, _retire_active(registry)
    else:
        status = CANDIDATE
    row = model.withColumn("status", F.lit(status)).select(*registry.columns)
    return upsert(registry, row, ["model_version"], REREGISTER_UPDATES)


def promote(registry: DataFrame, version: str) -> DataFrame:
    """The registry after making ``version`` the only active one; unknown versions are errors."""
    found = registry.where(F.col("model_version") == version).select("status").first()
    if found is None:
        raise LookupError(f"model {version} is not registered")
    if found["status"] == ACTIVE:
        return registry
    status = F.when(F.col("model_version") == version, ACTIVE).otherwise(F.col("status"))
    return _retire_active(registry).withColumn("status", status)


def list_models(registry: DataFrame) -> DataFrame:
    """Newest registration first."""
    return registry.orderBy(F.col("registered_at").desc(), F.col("model_version").desc())


def active_model(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status") == ACTIVE)


def get_model(registry: DataFrame, version: str) -> DataFrame:
    return registry.where(F.col("model_version") == version)
