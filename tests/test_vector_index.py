import numpy as np
import pytest
from lattica.operators import vector_index as vi
from lattica.operators import vectors as vc
from pyspark.sql import functions as F

KEYS = ["user_id", "name"]


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    return base.select(F.concat(F.lit("u"), F.col("vec_id") % 3).alias("user_id"), F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("name"), "vec_id", "embedding").cache()


@pytest.fixture(scope="module")
def asked(rows):
    return rows.where("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), "user_id", "embedding")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    """Built of a half of the rows; the others are added."""
    path = str(tmp_path_factory.mktemp("index"))
    return vi.build_index(rows.where("vec_id % 2 = 0"), path, KEYS).add(rows.where("vec_id % 2 = 1"))


def flat(df):
    return sorted((r.query_id, r.user_id, r["name"], round(r.score, 9)) for r in df.collect())


def test_recall(index, rows, asked):
    exact = {x[:3] for x in flat(vc.nearest(asked, rows, 10, KEYS))}
    found = {x[:3] for x in flat(index.search(asked, 10))}
    assert index.model.probes < len(index.model.centroids) and len(exact & found) >= 0.9 * len(exact)
    own = {x[:3] for x in flat(vc.nearest(asked, rows, 5, KEYS, by="user_id"))}
    mine = flat(index.search(asked, 5, by="user_id", depth=60))
    assert len(own & {x[:3] for x in mine}) >= 0.85 * len(own)
    assert all(u == f"u{q % 3}" for q, u, _, _ in mine)


def test_all_cells_and_candidates_are_the_exact_search(index, rows, asked):
    assert index.rows.count() == 2000
    assert flat(index.search(asked, 6, probes=10_000, depth=2000)) == flat(vc.nearest(asked, rows, 6, KEYS))
    assert flat(vi.vector_topk_approx(asked, index, 6)) == [x for x in flat(index.search(asked, 6)) if x[1] == f"u{x[0] % 3}"]


def test_only_probed_cells_are_read(index, asked):
    one = index.search(asked.limit(1), 3, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "codes" in line]
    assert scans and all("embedding" not in line.split("ReadSchema")[1] for line in scans)


def test_blocks_of_many_queries(index, asked, monkeypatch):
    want = flat(index.search(asked, 4)), flat(index.search(asked, 4, by="user_id"))
    monkeypatch.setattr(vi, "BLOCK", 3)
    monkeypatch.setattr(vi, "ROWS", 20)
    assert (flat(index.search(asked, 4)), flat(index.search(asked, 4, by="user_id"))) == want


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    odd = [("a", "x", [1.0, 0.0, 0.0, 0.0, 0.5]), ("a", "y", [0.0, 1.0, 0.0, 0.0, 0.0]), ("a", "y2", [0.0, 2.0, 0.0, 0.0, 0.0]), ("a", "z", [0.0] * 5), ("b", "n", None), ("b", "s", [1.0]), ("b", "e", [])]
    df = spark.createDataFrame(odd, "user_id string, name string, embedding array<float>")
    index = vi.build_index(df, str(tmp_path / "odd"), KEYS)
    asked = df.select(F.col("name").alias("query_id"), "user_id", "embedding")
    assert index.rows.count() == 3
    got = [x[:3] for x in flat(index.search(asked, 2, probes=9))]
    assert got == [("x", "a", "x"), ("x", "a", "y"), ("y", "a", "y"), ("y", "a", "y2"), ("y2", "a", "y"), ("y2", "a", "y2")]
    none = vi.build_index(df.limit(0), str(tmp_path / "none"), KEYS)
    assert none.search(asked, 2).count() == 0 and index.search(asked.limit(0), 2).count() == 0
    assert none.rows.count() == 0


def test_codes_come_near_the_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = vi.fitted(x, 20)
    cells, codes = m.encoded(x)
    near = m.scores(x[:50], cells, codes)
    assert np.abs(near - x[:50] @ x.T).mean() < 0.05
    assert codes.shape == (3000, 12) and m.probes <= 20
