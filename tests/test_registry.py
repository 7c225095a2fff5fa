from __future__ import annotations

import __spark_entry__ as entry
from signalspark.plans import registry


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    q, o = registry.queries(), registry.oracle_sql()
    assert set(q) - set(o) == {"c22_masked_tokens", "d07_dtw_similarity"}


def test_flagship_prefers_planted_field(spark):
    rows = entry.entry(spark).filter("rank = 1").collect()
    assert len(rows) == 10
    assert all(r.label == f"0x{r.arb_id:X}[1:3]BEu" and r.reference == f"ref_{r.arb_id}" and r.scale == 0.01 for r in rows)
