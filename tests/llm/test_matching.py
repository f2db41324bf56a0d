"""Matching: rules in order, contradictions, spots, confidence."""

from sonolith.llm.matching import RULES, match

M = 1 / 111_195  # degrees of latitude a metre


def matched(spark, records, units, labelled=None):
    r = spark.createDataFrame(records, "record_id long, key string, lat double, lon double, hub double, power double, farm string, maker string")
    u = spark.createDataFrame(units, "unit_id long, lat double, lon double, hub double, power double, farm string, maker string, gone boolean")
    return {(x.record_id, x.unit_id): (x.rule, x.confidence) for x in match(r, u, labelled).collect()}


def test_rules_and_contradictions(spark):
    records = [
        (1, "M1", 50.0, 8.0, 100.0, 2000.0, "Windpark Fernhöhe", "Nor X"), (2, "M1", 50.0 + 10 * M, 8.0, None, 0.0, None, None),
        (3, None, 50.0 + 20 * M, 8.0, 999.0, None, None, None), (4, "M2", 50.0 + 400 * M, 8.0, 100.0, 2000.0, "Fernhöhe", "Nor X"),
        (5, "M3", 0.0, 0.0, 100.0, 2000.0, None, None), (6, "M4", None, 8.0, 100.0, 2000.0, None, None), (7, "M5", 99.0, 8.0, 90.0, 1.0, None, None),
        (8, "M6", 60.0, 179.9999, 80.0, 3.0, None, None),
    ]
    units = [
        (1, 50.0 + 30 * M, 8.0, 100.0, 2.0, "fernhoehe II", "NOR", False), (2, 50.0 + 60 * M, 8.0, 101.0, None, None, None, None),
        (3, 50.0 + 40 * M, 8.0, 30.0, 0.3, "Fernhöhe", None, False), (4, 50.0, 8.0, 100.0, 2.0, "Fernhöhe", "NOR", True),
        (5, 50.0 + 420 * M, 8.0, 100.0, 2000.0, None, None, False), (6, 0.0, 0.0, 100.0, 2.0, None, None, False), (7, 60.0, -179.9999, 80.0, 3.0, None, None, False),
    ]
    got = matched(spark, records, units)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (3, 2), (4, 5), (8, 7)}
    assert got[(1, 1)][0] == "near_power_hub_farm" and got[(3, 2)][0] == "near_hub" and got[(1, 2)][0] == "same_spot" and got[(4, 5)][0] == "near_power_hub"
    assert all(0 < c <= 1 for _, c in got.values())


def test_labelled_precision(spark):
    records = [(i, f"M{i}", 50.0 + i, 8.0, 100.0, 2000.0, None, None) for i in range(10)]
    units = [(i, 50.0 + i, 8.0, 100.0, 2.0, None, None, False) for i in range(10)]
    labelled = spark.createDataFrame([(i, i, i > 1) for i in range(8)], "record_id long, unit_id long, same boolean")
    got = matched(spark, records, units, labelled)
    assert len(got) == 10 and abs(got[(0, 0)][1] - (6 + 1.8) / 10) < 1e-9


def test_empty_and_names(spark):
    assert matched(spark, [], []) == {}
    assert len({r.name for r in RULES}) == len(RULES)
