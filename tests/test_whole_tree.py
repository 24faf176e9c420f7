"""Trees below callers of more callees than the budget."""

from factweave.operators import tree as V


def test_hot_caller_hides_no_children(spark):
    e = [("r", "a", 1), ("r", "z", 2), ("z", "q", 1)] + [("a", f"c{i:03d}", i) for i in range(200)]
    tree = V.call_tree(spark.createDataFrame(e, "from_sym string, to_sym string, line int"), "r", budget=5)
    assert [(r.node, r.truncated) for r in tree.orderBy("ord").collect()] == [("r", None), ("a", "budget_capped"), ("z", None), ("q", None)]
