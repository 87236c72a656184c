"""Queries on labels and keys alone build no features."""

from creditloom.plans import catalog
from creditloom.plans.given_lake import GivenLake


def test_labels_and_keys_need_no_features(spark, sf):
    light = GivenLake(spark, sf)
    weights = {r.default_flag: r.n for r in catalog.class_weights(light).collect()}
    split = catalog.time_split(light)
    asked = catalog.assessment_questions(light).count()
    assert not {"feat_dti_ratio", "feat_credit_util"} & vars(light.silver).keys()
    assert not {"scoring", "decided"} & vars(light).keys()
    full = GivenLake(spark, sf)
    assert sum(weights.values()) == split.count() == full.training.count()
    assert asked == full.decided.count()
