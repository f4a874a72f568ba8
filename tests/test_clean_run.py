import __spark_entry__ as E
from tessera.plans import models


def test_clean_run_trains_every_model(spark):
    rows = E.queries()["clean_run"](spark, "/root/testdata/sf0.001").collect()
    names = {v for r in rows for v in r.asDict().values() if isinstance(v, str)}
    assert set(models.CLEAN_RUN) <= names
    assert len(rows) == len(models.CLEAN_RUN)
