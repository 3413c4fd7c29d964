"""Session contract: UTC, AQE, and the checkpoint folder read from the
session (only created when none is set)."""

import os

from civicframe.session import REQUIRED_CONF, checkpoint_dir


def test_required_settings(spark):
    for k, v in REQUIRED_CONF.items():
        assert spark.conf.get(k) == v


def test_checkpoint_dir_comes_from_session(spark):
    d = checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(d.replace("file:", ""))


def test_storage_plans_write_under_checkpoint_dir(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    top = checkpoint_dir(spark).replace("file:", "")

    def folders():
        return {n for d in os.listdir(top) if d.startswith("civicframe-") for n in os.listdir(f"{top}/{d}")}
    before = folders()
    E.queries()["orders_csv_round_trip"](spark, SF_SMALL).count()
    assert any(n.startswith("orders-csv-") for n in folders() - before)
