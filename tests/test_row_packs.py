"""Packs of a shelf row are dealt by row before they have vectors, so that no vector is shuffled."""

from __future__ import annotations

from shelfwright.operators import row_labels as RL


def test_no_vector_is_shuffled(spark):
    facings = spark.createDataFrame([(1, 1, i, i, "a" if i % 2 else None) for i in range(8)], "scan_id long, row_idx long, pos long, vid long, brand string")
    vectors = spark.createDataFrame([(i, [1.0, i / 8]) for i in range(8)], "id long, vec array<double>").hint("broadcast")
    pairs = RL.similar_in_row(facings, vectors, 1.0)
    assert pairs.count() == 4 * 8
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.index("RepartitionByExpression [scan_id")
    assert plan.index("Join Inner, (vid") < dealt  # the plan is written from the result down
    executed = pairs._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == executed.count("REPARTITION_BY_COL")
    got = {(r.pos, r.brand) for r in RL.propagate(facings, vectors, 1.0, 2).collect()}
    assert got == {(i, "a") for i in (0, 2, 4, 6)}
