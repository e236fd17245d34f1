import pytest

from tabulon.plans.catalogue import QUERIES

#: point_id, longitude, latitude: null and unusable coordinates, a shared position, one row without an outcome.
ODD = [(0, None, 1.0, 1.0), (1, 999.0, 1.0, 1.0), (2, 0.0, -90.5, 1.0), (3, float("nan"), 0.0, 1.0), (4, 7.0, 0.0, None)]


@pytest.fixture
def folder(spark, tmp_path):
    good = [(10 + i, 7.0 if i < 2 else 179.9 - 0.01 * i, 0.1 * i, float(i * i % 17)) for i in range(40)]
    data = [(k, lon, lat, 1.0 + k * 7 % 11, k * 5 % 13, v) for k, lon, lat, v in [*ODD, *good]]
    spark.createDataFrame(data, "point_id long, longitude double, latitude double, income double, density long, outcome double").write.parquet(f"{tmp_path}/spatial_analysis.parquet")
    return str(tmp_path)


def test_spatial_queries_read_the_usable_points(spark, folder):
    assert {r["id"] for r in QUERIES["points_lag"](spark, folder).collect()} == set(range(10, 50))
    assert QUERIES["moran_permutations"](spark, folder).count() == 999
    assert [r["term"] for r in QUERIES["slm_fit"](spark, folder).collect()] == ["CONSTANT", "income", "density", "W_outcome"]
