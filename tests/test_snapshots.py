from lodeweave.operators import orphans as O
from test_orphans import make


def test_each_period_has_a_snapshot(spark, tmp_path):
    make(spark, str(tmp_path), 1, 60)
    rows = O.snapshot(spark, str(tmp_path)).collect()
    ends = {str(r.period_end) for r in rows}
    assert ends == {"2024-07-01 00:00:00", "2025-01-01 00:00:00", "2025-07-01 00:00:00", "None"}
    # references of a later period are not in an earlier snapshot
    found = O.run_periods(spark, str(tmp_path))[0].collect()
    for r in rows:
        mine = [x for x in found if (x.ref_table, x.ref_field) == (r.ref_table, r.ref_field) and (r.period_end is None or x.at < r.period_end)]
        assert r.orphans == len(mine) and r.orphans == r.open + r.resolved - r.reopened
