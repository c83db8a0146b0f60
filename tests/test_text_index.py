import random

from lattica.operators import text_index as ti


def test_search_against_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcé ", k=n))
    texts = [(r.choice("uv"), word(r.randint(0, 12))) for _ in range(300)] + [(None, "abc"), ("u", None), ("u", "")]
    needles = [(r.choice("uvw"), word(r.randint(0, 6))) for _ in range(80)] + [(None, "a"), ("u", None), ("u", "")]
    df = spark.createDataFrame(texts, "user_id string, text string")
    index = ti.TextIndex(spark, str(tmp_path / "index")).add(df.limit(150)).add(df)
    asked = spark.createDataFrame(needles, "user_id string, needle string")
    want = sorted({(u, n, t) for u, n in needles for v, t in texts if u and u == v and n and t and n in t})
    assert sorted(map(tuple, index.search(asked).collect())) == want and len(want) > 200
    monkeypatch.setattr(ti, "TOLD", 3)
    assert sorted(map(tuple, index.search(asked).collect())) == want
    held = {(u, t) for u, t in texts if u is not None and t is not None}
    assert index.texts.count() == len(held)
    assert index.search(asked.limit(0)).count() == 0
    assert ti.TextIndex(spark, str(tmp_path / "none")).search(asked).count() == 0


def test_only_the_folders_of_the_runs_are_read(spark, tmp_path):
    df = spark.createDataFrame([("u", f"name number {i}") for i in range(500)], "user_id string, text string")
    index = ti.TextIndex(spark, str(tmp_path / "index")).add(df)
    found = index.search(spark.createDataFrame([("u", "r 499")], "user_id string, needle string"))
    assert [x.text for x in found.collect()] == ["name number 499"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "gram" in line.split("Batched")[0]]
    assert scan and all("PartitionFilters: [bucket" in line.replace("isnotnull(bucket", "bucket") or "bucket" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scan)
    assert any("In(gram" in line for line in scan)
