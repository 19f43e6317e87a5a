"""The engine over one large clean batch. ASSAY_VOLUME: its sales; people are a tenth of them."""

import os
import time
from decimal import Decimal

from assay.engine.runner import BatchScope, Engine
from assay.engine.store import Store
from assay.rules.library import shipped
from assay.sources import stored, volume

SALES = int(os.environ.get("ASSAY_VOLUME", "50000"))


def test_a_clean_batch_of_any_size(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    batch = volume.fill(store, SALES, SALES // 10, SALES // 200, SALES // 200)
    stored.register(store)
    engine = Engine(store, lambda: stored.register(store))
    for d in shipped():
        engine.register(d)
    began = time.time()
    got = engine.run(BatchScope(batch))
    took = time.time() - began
    assert got.status == "COMPLETED" and len(got.outcomes) == 7 and got.finding_count == 0
    assert took < 600
    # a batch's rules read that batch's folder only
    other = volume.fill(store, 10, 10, 10, 10)
    stored.register(store)
    plan = spark.sql(f"select * from sales_transaction where batch_id = {other}")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan
    # and a planted fault in it is found among the many
    store.append("sales_transaction", [(10**9, batch, 1, "S-odd", "G0", "P-nobody", "A0", volume.START, Decimal(1), "BOX")])
    again = engine.run(BatchScope(batch))
    assert {k: n for k, (_, n, _) in again.outcomes.items() if n} == {"SALES-ORPHAN-REF": 1, "SALES-NO-ALIGNMENT": 1}
