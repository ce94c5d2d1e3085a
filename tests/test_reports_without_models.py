"""Reports on the data and its preparation fit no model."""

import pytest

import __spark_entry__
from tabsmith.plans import automl

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dataset_report", "preprocessing_report", "dirty_dataset_report", "dirty_preprocessing_report"])
def test_reports_fit_no_model(spark, monkeypatch, name):
    from tabsmith.plans import catalog_models, catalog_rules
    for cached in (catalog_models._run, catalog_rules._dirty_prep):
        cached.cache_clear()

    def fitted(*a, **k):
        raise AssertionError("a model was fitted")
    monkeypatch.setattr(automl.K, "train_all", fitted)
    assert __spark_entry__.queries()[name](spark, SF).count() > 3
