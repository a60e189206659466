"""Semantics of features, quantization, search and evaluation on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from nearvote.functions.features import vectorized
from nearvote.functions.quantize import q8, q16
from nearvote.operators import balance, boxes, evaluate, hard_queries, ivf, knn, replay, stress
from nearvote.operators.balance import heavy_cells, rebalanced, split_centroids
from nearvote.operators.knn import decided, nearest, nearest_single, shape, streamed, voted
from nearvote.operators.scorers import scorer
from nearvote.sources.readers import read_limits, read_raw_workload, read_references, read_requests, read_runs, read_telemetry, read_workload
from nearvote.sources.writers import responses, write_report, write_responses, write_runs
from nearvote.streaming.scoring import answered, as_queries, request_stream, score_stream

DIMS = 14


def request(**changes):
    base = {
        "id": "a", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["m1", "m1"]}, "merchant": {"id": "m1", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248}, "last_transaction": None,
    }
    return base | changes


def written(tmp_path, rows):
    path = tmp_path / "rows.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def vectors(spark, tmp_path, *rows):
    return [list(r["q16"]) for r in vectorized(read_requests(spark, written(tmp_path, rows))).collect()]


def test_features(spark, tmp_path):
    assert vectors(spark, tmp_path, request()) == [[41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]]


def test_features_at_their_edges(spark, tmp_path):
    later = request(last_transaction={"timestamp": "2026-03-11T19:45:53Z", "km_from_current": 5000.0})  # in the future, and far
    offset = request(transaction={"amount": 1e9, "installments": 99, "requested_at": "2026-03-12T01:45:53+07:00"}, customer={"avg_amount": 0.0, "tx_count_24h": 99, "known_merchants": None})
    a, b = vectors(spark, tmp_path, later, offset)
    assert a[5:7] == [0, 10000]
    assert b[:5] == [10000, 10000, 10000, 7826, 3333] and b[11] == 10000 and b[8] == 10000
    (c,) = vectors(spark, tmp_path, request(merchant={"id": "m9", "mcc": "0000"}))
    assert c[11:] == [10000, 5000, 0]


def test_rounding_is_half_to_even(spark):
    from pyspark.sql import functions as F

    # the first three times 10000 are halves, in single precision too
    values = [0.03125, 0.09375, 0.15625, 9.0, -9.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(q16(F.col("x")).alias("a"), q8(F.col("x")).alias("b"))
    assert [r["a"] for r in df.collect()] == [312, 938, 1562, 32767, -32768]  # 312.5, 937.5, 1562.5
    assert [r["b"] for r in df.collect()] == [4, 12, 20, 127, -128]


def refs(spark, n=400, seed=3):
    x = np.random.default_rng(seed).integers(0, 10_000, (n, DIMS))
    rows = [(i, [int(v) for v in x[i]], [int(round(v * 127 / 10_000)) for v in x[i]], int(i % 3 == 0)) for i in range(n)]
    return x, spark.createDataFrame(rows, "ref_id long, q16 array<smallint>, q8 array<tinyint>, label int")


def as_query(df):
    return df.filter("ref_id % 20 = 0").withColumnRenamed("ref_id", "query_id").drop("label")


@pytest.mark.parametrize(("parts", "block"), [(1, 100), (7, 100), (3, 7)])
def test_nearest_is_brute_force_for_any_partitions(spark, parts, block):
    """Queries sent to all tasks, and dealt to a grid of blocks."""
    x, df = refs(spark)
    got = {(r["query_id"], r["rank"]): (r["ref_id"], r["distance"]) for r in nearest(df.repartition(parts), as_query(df), block=block, ref_block=90).collect()}
    for q in range(0, 400, 20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        for rank, i in enumerate(np.lexsort((np.arange(400), d))[:5], 1):
            assert got[q, rank] == (i, d[i])


def test_ties_and_few_references(spark):
    same = spark.createDataFrame([(i, [1] * DIMS, [1] * DIMS, 1) for i in (9, 4, 7)], "ref_id long, q16 array<smallint>, q8 array<tinyint>, label int")
    q = same.limit(1).withColumnRenamed("ref_id", "query_id").drop("label")
    assert [r["ref_id"] for r in nearest(same, q).orderBy("rank").collect()] == [4, 7, 9]
    (d,) = decided(voted(nearest(same, q))).collect()
    assert (d["frauds"], d["fraud_score"], d["approved"]) == (3, 0.6, False)
    assert nearest(same, q.limit(0)).count() == 0
    assert voted(nearest(same.limit(0), q), q).collect()[0]["frauds"] == 0


def test_search_of_all_cells_is_exact(spark):
    _, df = refs(spark)
    built = ivf.build(df, df.filter("ref_id < 10").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid"))
    exact = {r["query_id"]: r["frauds"] for r in voted(nearest(df, as_query(df))).collect()}
    got = ivf.search(built, as_query(df), ivf.Search(probes=10, candidates=400, early_stop=False)).collect()
    assert {r["query_id"]: r["frauds"] for r in got} == exact and {r["rows_scanned"] for r in got} == {400}
    repaired = ivf.search(built, as_query(df), ivf.Search(probes=1, candidates=400, box_repair=True)).collect()
    assert {r["query_id"]: r["frauds"] for r in repaired} == exact


@pytest.mark.parametrize("few", [1 << 16, 0], ids=["sent", "streamed"])
def test_candidates_are_those_of_brute_force(spark, monkeypatch, few):
    """Queries sent to the tasks, and streaming past several blocks of a cell, for which references are copied too."""
    monkeypatch.setattr(ivf, "FEW_QUERIES", few)
    monkeypatch.setattr(ivf, "QUERY_RUN", 7)
    monkeypatch.setattr(ivf, "REF_BLOCK", 20)
    asked = lambda q: ivf.between(ivf.nearest_cells(built, q, 3), 0, 3)
    x, df = refs(spark)
    eight = np.rint(x * 127 / 10_000).astype(int)
    built = ivf.build(df, df.filter("ref_id < 6").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid"))
    cell = ((x[:, None, :] - x[None, :6, :]) ** 2).sum(axis=2).argmin(axis=1)
    got = {}
    for r in ivf.candidates(built, asked(as_query(df)), 8).collect():
        got.setdefault(r["query_id"], []).append((r["coarse_rank"], r["ref_id"], r["coarse"], r["distance"], r["label"]))
    for q in range(0, 400, 20):
        order = np.argsort(((x[:6] - x[q]) ** 2).sum(axis=1), kind="stable")[:3].tolist()
        rows = sorted((int(((eight[i] - eight[q]) ** 2).sum()), order.index(cell[i]), i) for i in range(400) if cell[i] in order)[:8]
        assert sorted(got[q]) == [(k, i, c, int(((x[i] - x[q]) ** 2).sum()), int(i % 3 == 0)) for k, (c, _, i) in enumerate(rows, 1)]
    assert ivf.candidates(built, asked(as_query(df).limit(0)), 8).count() == 0


def test_centroids_follow_their_members(spark):
    x, df = refs(spark)
    two = df.filter("ref_id < 2").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid")
    far = two.unionByName(spark.createDataFrame([(2, [30_000] * DIMS)], two.schema))
    cell = ((x[:, None, :] - x[None, :2, :]) ** 2).sum(axis=2).argmin(axis=1)
    got = {r["cell_id"]: r["centroid"] for r in ivf.recomputed_centroids(ivf.assigned(df, far), far).collect()}
    assert got == {c: np.floor(x[cell == c].mean(axis=0) + 0.5).astype(int).tolist() for c in (0, 1)} | {2: [30_000] * DIMS}


def test_replay(spark, tmp_path):
    _, df = refs(spark)
    built = ivf.build(df, df.filter("ref_id < 10").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid")).stored(str(tmp_path / "index"))
    truth = replay.ground_truth(df, as_query(df), str(tmp_path))
    assert replay.ground_truth(df.limit(0), as_query(df), str(tmp_path)).orderBy("query_id").collect() == truth.orderBy("query_id").collect()  # read, not computed
    assert replay.ground_truth(df.limit(0), as_query(df), str(tmp_path), "other").agg({"frauds": "sum"}).first()[0] == 0
    few, all_ = replay.replay(built, as_query(df), truth, [ivf.Search(probes=1, early_stop=False), ivf.Search(probes=10, candidates=400, early_stop=False)]).orderBy("probes").collect()
    assert (all_["queries"], all_["otherwise"], all_["most_apart"], all_["first_fn"], all_["mean_scanned"]) == (20, 0, 0.0, None, 400.0)
    got = ivf.search(built, as_query(df), ivf.Search(probes=1, early_stop=False))
    apart = replay.differing(got, truth).collect()
    assert len(apart) == few["otherwise"] == few["fn"] + few["fp"] > 0 and len(replay.differing(got, truth, most=1).collect()) == 1
    assert {r["kind"] for r in replay.differing(got, truth, "fn").collect()} <= {"fn"} and few["first_fn"] == min((r["query_id"] for r in apart if r["kind"] == "fn"), default=None)
    hard = {r["query_id"] for r in truth.collect() if 0.3 <= r["fraud_score"] <= 0.8}
    assert {r["query_id"] for r in replay.between(as_query(df), truth).collect()} == hard


def test_configurations_as_text():
    assert replay.parsed("np=4, KP=24,BNP=16,bbr=1,ESPCT=40,odd,a=b=c") == ivf.Search(probes=4, candidates=24, borderline_probes=16, box_repair=True, early_stop_pct=40)
    with pytest.raises(ValueError, match="no setting"):
        replay.parsed("speed=9")
    assert len(replay.grid()) == 8 and replay.grid((1, 2), (32,), (0,), early_stop=False)[1] == ivf.Search(probes=2, candidates=32, early_stop=False)


def test_tree_of_hard_queries(spark, tmp_path):
    """The tree finds a rule, and as an expression and read back it says what the model says."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    rows = spark.createDataFrame([(*map(float, v), 0 if v[0] > 0.6 and v[2] < 0.5 else 1) for v in x], "f0 double, f1 double, f2 double, mode int")
    model, scores = hard_queries.trained(rows, depths=(1, 3), least=5)
    by = {r["depth"]: r["f1"] for r in scores.collect()}
    assert by[3] > 0.9 > by[1]
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(rows)
    hard_queries.save(model, str(tmp_path / "tree"))
    again = hard_queries.load(str(tmp_path / "tree")).transform(ready).withColumn("said", hard_queries.as_column(model, ["f0", "f1", "f2"]))
    assert again.filter(F.col("prediction") != F.col("said")).count() == 0 and again.filter("said = 1 and mode = 0").count() > 100
    # the scores are those of the rows held out, counted anew
    held = again.filter(F.pmod(F.xxhash64("f0", "f1", "f2", F.lit(42)), F.lit(5)) == 0).collect()
    count = lambda said, mode: sum(r["said"] == said and (r["mode"] == 0) == mode for r in held)
    (best,) = [r for r in scores.collect() if r["depth"] == 3]
    assert (best["tp"], best["fp"], best["fn"]) == (count(1.0, True), count(1.0, False), count(0.0, True)) and 60 < len(held) < 180
    assert abs(best["f1"] - 2 * best["tp"] / (2 * best["tp"] + best["fp"] + best["fn"])) < 1e-12


def test_constants_from_files(spark, tmp_path):
    names = dict(zip(("max_amount", "max_installments", "amount_vs_avg_ratio", "max_minutes", "max_km", "max_tx_count_24h", "max_merchant_avg_amount"), (82.24, 12, 10, 1440, 1000, 20, 10_000), strict=True))
    (tmp_path / "c.json").write_text(json.dumps(names))
    (tmp_path / "r.json").write_text(json.dumps({"5411": 0.9}))
    limits = read_limits(spark, str(tmp_path / "c.json"), str(tmp_path / "r.json"))
    (row,) = vectorized(read_requests(spark, written(tmp_path, [request()])), limits).collect()
    assert row["q16"][0] == 5000 and row["q16"][12] == 9000 and read_limits(spark, str(tmp_path / "c.json")).mcc_risk["5411"] == 0.15
    (tmp_path / "r.json").write_text(json.dumps({"541": 0.9}))
    with pytest.raises(ValueError, match="four characters"):
        read_limits(spark, str(tmp_path / "c.json"), str(tmp_path / "r.json"))


def test_reports_and_responses(spark, tmp_path):
    decisions = spark.createDataFrame([(i, i / 5) for i in range(6)] + [(9, 0.43)], "query_id long, fraud_score double")
    bodies = {r["query_id"]: r["body"] for r in responses(decisions).collect()}
    assert bodies[0] == '{"approved":true,"fraud_score":0}' and bodies[3] == '{"approved":false,"fraud_score":0.6}' and bodies[5] == '{"approved":false,"fraud_score":1}' and bodies[9] == '{"approved":true,"fraud_score":0.4}'
    write_responses(decisions, str(tmp_path / "responses"))
    assert spark.read.json(str(tmp_path / "responses")).count() == 7
    write_report(decisions, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).columns == ["query_id", "fraud_score"]
    run = spark.sql("select named_struct('p50', 1D, 'p90', 1.2D, 'p99', 2D, 'max', 9D) as latency, named_struct('final_score', 5708D) as scoring")
    write_runs(run, str(tmp_path / "runs"))
    (back,) = read_runs(spark, str(tmp_path / "runs") + "/*.json").collect()
    assert back["latency"]["p99"] == 2.0 and back["scoring"]["final_score"] == 5708.0


def test_index_on_disk(spark, tmp_path):
    _, df = refs(spark)
    built = ivf.build(df, df.filter("ref_id < 4").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid"))
    built.write(str(tmp_path / "index"))
    again = ivf.Index.read(spark, str(tmp_path / "index"))
    how = ivf.Search(probes=2, early_stop=False)
    one, two = ({r["query_id"]: (r["frauds"], r["rows_scanned"]) for r in ivf.search(i, as_query(df), how).collect()} for i in (built, again))
    assert one == two


def test_heavy_cells_split_and_full_ones_give_away(spark):
    _, df = refs(spark)
    two = df.filter("ref_id < 2").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid")
    in_two = ivf.assigned(df, two)
    assert heavy_cells(in_two, 100).count() == 2
    more = split_centroids(in_two, two, 100)
    assert more.count() == more.select("cell_id").distinct().count() > 2
    even = rebalanced(ivf.assigned(df, more), more, 0.2).groupBy("cell_id").count().collect()
    assert sum(r["count"] for r in even) == 400 and max(r["count"] for r in even) <= math.ceil(400 / more.count() * 1.2)


def test_scorer_names():
    assert scorer() is scorer("BRUTE") is scorer("q16")
    with pytest.raises(ValueError):
        scorer("none")


def test_composite_score(spark):
    from pyspark.sql import functions as F

    def score(p99, fp, fn, errors, n):
        found = evaluate.composite(*(F.lit(v) for v in (p99, fp, fn, errors, n)))
        return spark.range(1).select(*[c.alias(k) for k, c in found.items()]).collect()[0].asDict()

    assert score(1.0, 0, 0, 0, 1000) == {"latency_score": 3000.0, "detection_score": 3000.0, "final_score": 6000.0}
    assert score(2500.0, 0, 0, 0, 10)["latency_score"] == -3000.0 and score(0.0, 0, 0, 0, 10)["latency_score"] == 0.0
    assert score(1.0, 2, 0, 0, 10)["detection_score"] == -3000.0


def test_p_value(spark):
    """Against tabulated values, and against the tail integrated by small steps."""
    from pyspark.sql import functions as F

    cases = [(2.228, 10.0), (0.0, 5.0), (12.706, 1.0), (1.96, 1e6), (0.001, 1e6), (40.0, 30.0), (3.5, 2.7)]
    got = [r["p"] for r in spark.createDataFrame(cases, "t double, df double").select(evaluate.p_value(F.col("t"), F.col("df")).alias("p")).collect()]
    assert [round(p, 3) for p in got[:3]] == [0.05, 1.0, 0.05] and abs(got[3] - 0.05) < 1e-4 and abs(got[4] - 0.9992) < 1e-4 and got[5] < 1e-20
    x = np.linspace(0, 3.5, 200_001)
    density = (1 + x * x / 2.7) ** (-(2.7 + 1) / 2) * math.exp(math.lgamma(3.7 / 2) - math.lgamma(2.7 / 2)) / math.sqrt(2.7 * math.pi)
    assert abs(got[6] - (1 - 2 * np.trapezoid(density, x))) < 1e-6


def test_comparison_of_runs(spark):
    runs = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0), ("a", 4.0, 0.0), ("b", 3.0, 1.0), ("b", 5.0, 1.0), ("c", 9.0, 9.0)], "arm string, p99 double, fn double")
    rows = {r["metric"]: r for r in evaluate.comparison(runs, ["p99", "fn"], "arm", "a", "b").collect()}
    assert (rows["p99"]["median_first"], rows["p99"]["median_second"], rows["p99"]["change_pct"]) == (2.0, 4.0, 100.0) and 0 < rows["p99"]["p"] < 1
    assert rows["fn"]["change_pct"] is None and rows["fn"]["t"] is None and rows["fn"]["p"] is None  # from 0, and without spread
    (one,) = evaluate.comparison(runs, ["p99"], "arm", "a", "c").collect()
    assert one["t"] is None and one["runs_second"] == 1
    (m,) = evaluate.medians(runs.filter("arm = 'a'"), ["p99", "fn"]).collect()
    assert (m["runs"], m["p99"], m["fn"]) == (3, 2.0, 0.0)


def test_percentiles(spark):
    (r,) = evaluate.percentiles(spark.createDataFrame([(float(v),) for v in [*range(100), 5, 5]], "v double"), "v").collect()
    values = sorted([*map(float, range(100)), 5.0, 5.0])
    assert (r["p50"], r["p99"], r["n"]) == (values[51], values[100], 102)


def test_stress_sets_are_seeded(spark):
    a, b = (stress.uniform(spark, 20, DIMS).repartition(p).orderBy("query_id").collect() for p in (1, 3))
    assert a == b
    v = spark.createDataFrame([Row(query_id=1, v=[-1.0] * DIMS)])
    assert all(0 <= x <= 10_000 for x in stress.jittered(v, 0.1, DIMS).collect()[0]["q16"])


def test_readers(spark, tmp_path):
    good = tmp_path / "refs.json"
    good.write_text(json.dumps([{"vector": [0.5] * DIMS, "label": "fraud"}, {"vector": [-1] * DIMS, "label": "legit"}]))
    assert [(r["q16"][0], r["label"]) for r in read_references(spark, str(good)).collect()] == [(5000, 1), (-10000, 0)]
    good.write_text(json.dumps([{"vector": [0.5], "label": "fraud"}]))
    with pytest.raises(Exception, match="reference needs"):
        read_references(spark, str(good)).collect()
    (tmp_path / "w.json").write_text(json.dumps({"entries": [{"request": request(), "expected_approved": True, "expected_fraud_score": 0.2}]}))
    (w,) = read_workload(spark, str(tmp_path / "w.json")).collect()
    assert w["id"] == "a" and w["expected_approved"] and w["transaction"]["installments"] == 2
    (tmp_path / "t.csv").write_text(",".join(["0.5"] * 14) + ",1000,1\n")
    assert read_telemetry(spark, str(tmp_path / "t.csv")).collect()[0]["rows"] == 1000
    (bad,) = read_requests(spark, written(tmp_path, [request(transaction={"amount": 1.0, "installments": 3.5, "requested_at": "x"})])).collect()
    assert bad["_corrupt"] is not None


def test_queries_of_requests(spark, tmp_path):
    (q,) = as_queries(read_requests(spark, written(tmp_path, [request()])).cache()).collect()
    assert q["id"] == "a" and len(q["q16"]) == len(q["q8"]) == DIMS and q["reason"] is None


def test_each_request_gets_the_answer_that_it_gets_alone(spark, tmp_path):
    """Repeated, without an id, under the id of another, malformed and incomplete, in a batch and in a stream."""
    x, df = refs(spark)
    other = request(id=None, transaction={"amount": 9000.0, "installments": 12, "requested_at": "2026-03-11T04:45:53Z"}, merchant={"id": "m9", "mcc": "7801", "avg_amount": 9000.0})
    timeless = request(transaction={"amount": 1.0, "installments": 1})
    unread = request(transaction={"amount": 1.0, "installments": 1, "requested_at": "soon"})
    before = request(last_transaction={"timestamp": "yesterday", "km_from_current": 1.0})
    lines = [json.dumps(r) for r in (request(), request(), other, other | {"id": "a"}, timeless, unread, before)] + ['{"id": "cut', "none", "null"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.json").write_text("\n".join(lines))
    rows = as_queries(read_requests(spark, str(tmp_path / "in"))).cache()
    score = lambda q: decided(voted(nearest(df, q), q))
    answers = answered(rows.filter("reason is null"), score).collect()
    want = {}
    for r in (request(), other):
        (q,) = as_queries(read_requests(spark, written(tmp_path, [r]))).withColumn("query_id", F.lit(1)).select("query_id", "q16", "q8").collect()
        d = ((x - np.array(q["q16"])) ** 2).sum(axis=1)
        want[tuple(q["q16"])] = sum(int(i % 3 == 0) for i in np.lexsort((np.arange(400), d))[:5])
    assert len(want) == 2 and sorted(str(a["id"]) for a in answers) == ["None", "a", "a", "a"]
    assert all(a["frauds"] == want[tuple(a["q16"])] for a in answers)
    reasons = sorted(r["reason"] for r in rows.filter("reason is not null").collect())
    assert reasons == ["incomplete"] * 3 + ["malformed"] * 3

    out, bad = [], []
    index = ivf.Index(df, df.limit(0), DIMS)
    stream = as_queries(request_stream(spark, str(tmp_path / "in")))
    score_stream(stream, index, lambda rows, _: out.extend(rows.collect()), str(tmp_path / "checkpoint"), "brute", rejected=lambda rows, _: bad.extend(rows.collect())).awaitTermination()
    assert sorted((str(r["id"]), r["frauds"]) for r in out) == sorted((str(r["id"]), r["frauds"]) for r in answers)
    assert sorted(r["reason"] for r in bad) == reasons and any(r["line"] == "none" for r in bad)


def test_a_query_id_must_not_repeat(spark):
    _, df = refs(spark)
    twice = as_query(df).unionByName(as_query(df))
    built = ivf.build(df, df.filter("ref_id < 4").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid"))
    for found in (lambda: nearest(df, twice), lambda: nearest(df, twice, block=3), lambda: ivf.search(built, twice)):
        with pytest.raises(ValueError, match="query_id"):
            found().collect()


def test_a_query_of_empty_cells_has_no_frauds(spark):
    _, df = refs(spark)
    two = spark.createDataFrame([(0, [5000] * DIMS), (1, [30_000] * DIMS)], "cell_id int, centroid array<int>")
    built = ivf.build(df, two)
    asked = spark.createDataFrame([(1, [30_000] * DIMS, [127] * DIMS), (2, [5000] * DIMS, [64] * DIMS)], "query_id long, q16 array<smallint>, q8 array<tinyint>")
    for how in (ivf.Search(probes=1), ivf.Search(probes=1, early_stop=False, borderline_probes=2)):
        rows = {r["query_id"]: (r["frauds"], r["approved"], r["rows_scanned"]) for r in ivf.search(built, asked, how).collect()}
        assert rows[1] == (0, True, 0) and rows[2][2] >= 400 and len(rows) == 2
    (one,) = [r for r in ivf.search(built, asked, ivf.Search(probes=1, box_repair=True)).collect() if r["query_id"] == 1]
    assert one["rows_scanned"] == 400 and one["mode"] == 3


def test_nulls_are_not_the_largest_number(spark):
    df = spark.createDataFrame([([1.0, None],)], "v array<double>").select(F.transform("v", q16).alias("a"), F.transform("v", q8).alias("b"))
    assert list(df.first()) == [[10_000, None], [127, None]]


def test_queries_are_copied_for_blocks_and_references_for_runs():
    assert shape(3_000_000, 100_000_000, 8) == (23, 96)  # not one copy of references for each block of queries
    assert shape(1_000_000, 100_000, 8) == (8, 1) and shape(100, 100, 8) == (1, 1) and shape(0, 0, 8) == (1, 1)


def test_many_queries_pass_without_copies_of_references(spark):
    x, df = refs(spark)
    q = as_query(df).select("query_id", F.col("q16").cast("array<int>").alias("v"))
    r = df.select("ref_id", F.col("label").cast("long").alias("label"), F.col("q16").cast("array<int>").alias("v"))
    rows = {k: n for k, n in streamed(q, r, 5, 1).groupBy("kind").count().collect()}
    assert rows == {0: 400, 1: 100}
    rows = {k: n for k, n in streamed(q, r, 5, 2).groupBy("kind").count().collect()}
    assert rows == {0: 800, 1: 100}
    one, two = (nearest(df, as_query(df), block=b, ref_block=60, run=9).orderBy("query_id", "rank").collect() for b in (100, 3))
    assert one == two


@pytest.mark.parametrize("block", [100, 3])
def test_single_precision_search(spark, block):
    """Sums in the order of dimensions, of nearly equal and of equal distances."""
    rng = np.random.default_rng(6)
    x = rng.random((300, 20), np.float32)
    x[50:120] = x[3] + rng.random((70, 20), np.float32) * np.float32(1e-7)
    x[120:140] = x[4]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 2) for i in range(300)], "ref_id long, v array<float>, label int").repartition(3)
    asked = df.filter("ref_id % 10 < 5").selectExpr("ref_id as query_id", "v")
    got = {}
    for r in nearest_single(df, asked, block=block, ref_block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["ref_id"], np.float32(r["distance"])))
    assert len(got) == 150
    for q, found in got.items():
        d = np.zeros(300, np.float32)
        for k in range(20):
            d += (x[:, k] - x[q, k]) * (x[:, k] - x[q, k])
        order = np.lexsort((np.arange(300), d))[:5]
        assert found == [(int(i), d[i]) for i in order]


def test_early_stop_scans_no_cell_twice(spark, monkeypatch):
    _, df = refs(spark)
    built = ivf.build(df, df.filter("ref_id < 10").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid"))
    seen, plain = [], ivf.candidates
    monkeypatch.setattr(ivf, "candidates", lambda index, asked, most: (seen.extend((r["query_id"], c) for r in asked.collect() for c in r["cells"]), plain(index, asked, most))[1])
    for how in (ivf.Search(probes=8, early_stop_pct=50, early_stop_pct_first=25), ivf.Search(probes=2, box_repair=True), ivf.Search(probes=2, borderline_probes=6, early_stop=False)):
        seen.clear()
        ivf.search(built, as_query(df), how).collect()
        assert len(seen) == len(set(seen)) and len(seen) >= 40
    seen.clear()
    rows = ivf.what_if_answers(built, as_query(df), ivf.Search(probes=8), (10, 30, 50, 70, 90, 100)).collect()
    assert len(seen) == len(set(seen)) == 160 and len(rows) == 120
    assert all(r["slack"] == float("inf") and r["frauds"] == r["full"] for r in rows if r["pct"] == 100)
    least = {r["query_id"]: r["least_pct"] for r in ivf.least_passing(ivf.what_if_answers(built, as_query(df), ivf.Search(probes=8), (10, 30, 50, 70, 90, 100))).collect()}
    assert all(least[q] == min([r["pct"] for r in rows if r["query_id"] == q and r["passed"]], default=-1) for q in least)


def test_row_budget(spark):
    _, df = refs(spark)
    built = ivf.build(df, df.filter("ref_id < 10").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid"))
    largest = built.cells.agg({"size": "max"}).first()[0]
    rows = ivf.search(built, as_query(df), ivf.Search(probes=10, row_budget=100, early_stop=False)).collect()
    assert len(rows) == 20 and all(100 <= r["rows_scanned"] < 100 + largest for r in rows)


def test_k_means_in_rounds(spark):
    """Against NumPy, with a cell that gets empty and begins anew; the same for any partitions."""
    x, df = refs(spark)
    first = df.filter("ref_id < 4").selectExpr("cast(ref_id as int) cell_id", "cast(q16 as array<int>) centroid").unionByName(spark.createDataFrame([(4, [32_000] * DIMS)], "cell_id int, centroid array<int>"))
    c = np.vstack([x[:4], np.full((1, DIMS), 32_000)]).astype(float)
    for _ in range(3):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([np.floor(x[near == k].mean(axis=0) + 0.5) if (near == k).any() else x[k * 2654435761 % 2**32 % 400] for k in range(5)])
    for parts in (1, 5):
        got = {r["cell_id"]: r["centroid"] for r in ivf.lloyd(df.repartition(parts), first, 3, settled=0).collect()}
        assert got == {k: c[k].astype(int).tolist() for k in range(5)}
    assert ivf.trained_centroids(df, 7).orderBy("cell_id").collect() == ivf.trained_centroids(df.repartition(5), 7).orderBy("cell_id").collect()
    assert ivf.trained_centroids(df.limit(3), 7).count() == 3 and ivf.trained_centroids(df.limit(0), 7).count() == 0


def test_first_places_by_counting(spark, monkeypatch):
    """Ties at the place, ids of either sign, cells with more places than rows, and digits of any size."""
    rng = np.random.default_rng(5)
    rows = [(int(i), int(c), int(d)) for i, c, d in zip(rng.permutation(1000) * 10**15 - 5 * 10**17, rng.integers(0, 4, 1000), rng.integers(0, 30, 1000) ** 8, strict=True)]
    df = spark.createDataFrame(rows, "ref_id long, cell int, d long").repartition(4)
    places = {0: 100, 1: 5000, 2: 1, 9: 7}
    for bits in (16, 4):
        monkeypatch.setattr(balance, "DIGIT", bits)
        got = balance.first_places(df, spark.createDataFrame(list(places.items()), "cell int, place int"), "cell").collect()
        want = [r for c, n in places.items() for r in sorted((d, i, c) for i, c2, d in rows if c2 == c)[:n]]
        assert sorted((r["d"], r["ref_id"], r["cell"]) for r in got) == sorted(want)


def test_medians_by_counting(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 8.0), (None, 5.0), ("b", None)]
    df = spark.createDataFrame(rows, "arm string, v double")
    assert {r["arm"]: r["median"] for r in evaluate.middles(df, "v", ["arm"]).collect()} == {"a": 2.0, None: 5.0}
    assert {r["arm"]: (r["runs"], r["median"]) for r in evaluate.over_runs(df, "v", ["arm"]).collect()} == {"a": (4, 2.0), None: (1, 5.0), "b": (0, None)}


def test_raw_workload(spark, tmp_path):
    sent = request() | {"note": {"deep": [1, None, "x"]}}
    (tmp_path / "w.json").write_text(json.dumps({"entries": [{"request": sent, "expected_approved": True, "expected_fraud_score": 0.2}, {"request": request(id="b"), "expected_approved": False, "expected_fraud_score": 0.8}]}))
    rows = {r["id"]: r for r in read_raw_workload(spark, str(tmp_path / "w.json")).withColumn("text", F.to_json("raw")).drop("raw").collect()}
    assert json.loads(rows["a"]["text"]) == sent and rows["a"]["transaction"]["installments"] == 2 and rows["a"]["expected_approved"] and not rows["b"]["expected_approved"]


def test_cells_in_groups_are_ranked_as_all_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centers = rng.integers(0, 10_000, (12, 6))
    c = (centers[rng.integers(0, 12, 3000)] + rng.integers(-300, 300, (3000, 6))).astype(float)
    c[100:110] = c[5]
    low, sizes = c - rng.integers(0, 50, c.shape), rng.integers(0, 3, 3000)
    plain = ivf.Cells(np.arange(3000), c, sizes, low, c + 40)
    held = ivf.replace(plain, groups=ivf.Groups.of(plain))
    q = np.vstack([rng.integers(0, 10_000, (40, 6)), c[:40]]).astype(float)
    compared, plain_some = [], ivf.Cells.to_some
    monkeypatch.setattr(ivf.Cells, "to_some", lambda self, x, places, guided: (compared.append(len(places)), plain_some(self, x, places, guided))[1])
    for guided in (False, True):
        compared.clear()
        got = held.nearest(q, 9, guided)
        assert sum(compared) < 0.5 * 3000 * len(q)
        want = plain.nearest(q, 9, guided)
        assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_commas_before_closing_brackets(spark, tmp_path):
    (tmp_path / "refs.json").write_text('[{"vector": [' + "0.5, " * DIMS + '], "label": "fraud",}, {"label": "legit", "vector": [' + ", ".join(["-1"] * DIMS) + " ,\n]},\n]")
    got = read_references(spark, str(tmp_path / "refs.json"), last_commas=True).collect()
    assert sorted((r["q16"][0], r["label"]) for r in got) == [(-10_000, 0), (5000, 1)]
    (tmp_path / "refs.json").write_text('[{"vector": [0.5], "label": "fraud"}]')
    with pytest.raises(Exception, match="reference needs"):
        read_references(spark, str(tmp_path / "refs.json"), last_commas=True).collect()


def clustered(spark, n, clusters=3):
    """References in clusters on a coarse grid, many at one place and many as near as others; every seventh is a copy of vector 0."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, clusters, (n, 1)) * (27_000 // clusters) + rng.integers(0, 4, (n, DIMS)) * 100
    x[::7] = x[0]
    order = rng.permutation(n)  # ids say nothing of places
    rows = [(int(i), v.tolist(), int(i) % 3 % 2) for i, v in zip(order, x, strict=True)]
    return order, x, spark.createDataFrame(rows, "ref_id long, q16 array<smallint>, label int")


def test_search_by_boxes_is_exact_and_scans_few(spark):
    """Ties across cells, copies, queries far from all and of cells with fewer than k references."""
    order, x, df = clustered(spark, 3000)
    asked = np.concatenate([x[:150], x[:30] + 50, np.full((2, DIMS), 30_000), np.full((1, DIMS), -9000)])
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, v array<int>")
    r = df.select("ref_id", F.col("label").cast("long").alias("label"), F.col("q16").cast("array<int>").alias("v"))
    for cell, seen in ((64, 1 << 16), (2, 1 << 16), (64, 100)):
        found = knn.ranked(boxes.searched(r, q, 5, len(asked), seen=seen, cell=cell, most_share=1.1), ["distance", "ref_id"], 5)
        got = {(a["query_id"], a["rank"]): (a["ref_id"], a["distance"]) for a in found.collect()}
        assert len(got) == 5 * len(asked)
        for i, v in enumerate(asked):
            d = ((x - v) ** 2).sum(axis=1)
            assert [got[i, k + 1] for k in range(5)] == [(int(order[j]), int(d[j])) for j in np.lexsort((order, d))[:5]]
    assert boxes.searched(r, q, 5, len(asked), cell=64, most_share=0.03) is None  # then all pairs are compared


def test_many_queries_of_clusters_are_not_compared_with_all_references(spark, monkeypatch):
    order, x, df = clustered(spark, 40_000, 27)
    q = df.filter("ref_id % 100 = 1").select(F.col("ref_id").alias("query_id"), "q16")
    want = nearest(df, q).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(knn, "streamed", None)
    assert nearest(df, q, block=9).orderBy("query_id", "rank").collect() == want
