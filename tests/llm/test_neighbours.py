import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import neighbours


def brute(rows, k):
    found = {}
    for g in {r[0] for r in rows}:
        part = [(i, np.array(v, np.float32).astype(float)) for h, i, v in rows if h == g]
        for i, v in part:
            scored = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in part if j != i)
            found[i] = [j for _, j in scored[:k]]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(g, i, [float(x) for x in v] if v is not None else None, 0) for g, i, v in rows], "run string, id string, v array<float>, cosine int")


def neighbours_of(spark, rows, **options):
    out = neighbours.nearest(frame(spark, rows), group="run", id_="id", vector="v", dim=8, k=3, **options)
    return {r.id: [n.id for n in r.neighbours] for r in out.collect()}


def test_exact_groups_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [("a", f"a{k:03}", rng.standard_normal(8)) for k in range(60)] + [("b", f"b{k}", rng.standard_normal(8)) for k in range(2)]
    rows += [("a", f"copy{k:02}", np.ones(8)) for k in range(12)]
    bad = [("a", "null", None), ("a", "zero", np.zeros(8)), ("a", "nan", np.full(8, np.nan)), ("a", "inf", np.full(8, np.inf)), ("a", "short", np.ones(5)), (None, "alone", np.ones(8))]
    assert neighbours_of(spark, rows + bad) == brute(rows, 3)
    assert neighbours_of(spark, []) == {} and neighbours_of(spark, bad) == {}


def test_forest_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 8))
    rows = [("g", f"{k:05}", centres[k % 40] + 0.3 * rng.standard_normal(8)) for k in range(1500)] + [("g", f"same{k:03}", np.ones(8)) for k in range(700)]
    truth = brute(rows, 3)
    got = neighbours_of(spark, rows, leaf_rows=20, trees=8, shard_rows=600, slice_rows=300)
    assert got.keys() == truth.keys()
    hits = sum(len(set(got[i]) & set(truth[i])) for i in truth)
    assert hits / sum(map(len, truth.values())) > 0.9
    assert got["same010"] == ["same000", "same001", "same002"]


def test_recall_of_the_forest(spark):
    """Vectors without close neighbours, which is the hardest case; the exact way has them all."""
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((6000, 64)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    best = np.argpartition(-cosine, 5, axis=1)[:, :5]
    rows = frame(spark, [("g", f"{k:05}", v) for k, v in enumerate(unit)])
    for options, least in (({}, 0.9), ({"shard_rows": 2000}, 0.9), ({"exact": True, "shard_rows": 2500}, 0.9999)):
        got = {int(r.id): {int(n.id) for n in r.neighbours} for r in neighbours.nearest(rows, group="run", id_="id", vector="v", **options).collect()}
        assert sum(len(got[k] & set(best[k].tolist())) for k in range(6000)) / best.size >= least


def test_queue_pops_leaves_by_margin():
    """Against all margins of all nodes: a leaf's priority is the least margin on its way."""
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((900, 16)).astype(np.float32)
    forest = neighbours.Forest(unit, 3, 30, 1)
    queries = unit[:50]
    got = forest.visited(queries, 20)
    for q, leaves in zip(queries, got.tolist()):
        priority = np.full(3 * forest.leaves, np.inf)
        for tree in range(3):
            for leaf in range(forest.leaves):
                node = leaf + forest.leaves
                while node > 1:
                    side = q @ forest.normals[tree, node // 2 - 1] - forest.offsets[tree, node // 2 - 1]
                    priority[tree * forest.leaves + leaf] = min(priority[tree * forest.leaves + leaf], side if node % 2 else -side)
                    node //= 2
        own = set(np.argsort(-priority, kind="stable")[:3].tolist())
        assert set(leaves[:3]) == own and len(set(leaves)) == 20
        assert np.allclose(sorted(np.minimum(priority[leaves[3:]], 0)), sorted(np.sort(-np.maximum(-np.delete(priority, leaves[:3]), 0))[::-1][:17]), atol=1e-5)
    assert sorted(forest.rows[0].tolist()) == list(range(900))


def test_found_pairs(spark, tmp_path):
    v = [1.0] * 64
    chunks = [("x", "r1", "./a.py", "H1", v), ("y", "r1", "a.py", "h1", v), ("z", "r1", "b.py", "h2", v), ("o", "r2", "b.py", "h2", v), ("n", "r1", "c.py", "h3", None)]
    frame = spark.createDataFrame(chunks, "id string, index_run_id string, file_path string, content_hash string, embedding array<float>")
    frame.write.parquet(str(tmp_path / "code_chunks.parquet"))
    spark.createDataFrame([("r1", "completed"), ("r2", "superseded")], "id string, status string").write.parquet(str(tmp_path / "index_runs.parquet"))
    assert [tuple(r) for r in neighbours.p3_found(spark, str(tmp_path)).collect()] == [("x", "z")]
    assert neighbours.p3_neighbours(spark, str(tmp_path)).where(F.col("cosine") >= 0.9).count() == 2
