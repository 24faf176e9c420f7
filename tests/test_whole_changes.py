"""Changes of bodies in several solutions."""

from factweave.operators import impact as I


def test_body_changes_in_each_solution(spark):
    s = "solution_path string, symbol_id string, body_hash string"
    # the least hash of each symbol over all solutions stays
    base = spark.createDataFrame([("s1", "a", "1"), ("s2", "a", "5"), ("s1", "b", "1"), ("s2", "b", "2"), ("s1", "c", "1"), ("s2", "c", "3"), ("s1", "d", "1"), ("s1", "e", "1"), ("s2", "e", "1")], s)
    head = spark.createDataFrame([("s1", "a", "1"), ("s2", "a", "6"), ("s1", "b", "1"), ("s1", "c", "1"), ("s2", "c", "3"), ("s1", "d", "1"), ("s2", "d", "9"), ("s1", "e", "2"), ("s2", "e", "2")], s)
    assert sorted(r[0] for r in I.body_changes(base, head, ["solution_path"]).collect()) == ["a", "b", "d", "e"]
