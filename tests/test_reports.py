import json

import pytest

from quernstone.sources import reports


def test_points_are_whole_or_refused(spark):
    points = spark.createDataFrame([(0.5, 2), (0.9, 1)], "tau double, n_auto int")
    assert json.loads(reports.points_json(points)) == [{"tau": 0.9, "n_auto": 1}, {"tau": 0.5, "n_auto": 2}]
    with pytest.raises(ValueError):
        reports.points_json(spark.range(100_001).selectExpr("id / 100001 as tau", "id as n_auto"))
