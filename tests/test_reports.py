"""Reports, the five modules over a study, whole comparisons, models, and what goes into a bundle."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import schema as S
from wavelake.functions import distributions as D
from wavelake.functions import learning
from wavelake.operators import statistics as X
from wavelake.plans import pipelines
from wavelake.sources import writers


def test_whole_comparison_equals_its_parts_in_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(10, 2, 40), rng.normal(9, 2, 35)
    rows = [("m", "A", i, float(x)) for i, x in enumerate(a)] + [("m", "B", i, float(x)) for i, x in enumerate(b)] + [("m", "A", 99, None), ("m", "B", 99, float("nan"))]
    df = spark.createDataFrame(rows, "metric string, g string, i int, value double")
    r = X.rigorous(df, ["metric"], "g", "A", "B", "i").collect()[0]
    d = a[:35] - b
    assert (r.n_a, r.n_b, r.df) == (40, 35, 34)
    assert [r.mean_a, r.std_a, r.mean_b, r.std_b] == pytest.approx([a.mean(), a.std(ddof=1), b.mean(), b.std(ddof=1)])
    t = d.mean() / d.std(ddof=1) * np.sqrt(35)
    assert [r.mean_diff, r.t_stat, r.d] == pytest.approx([d.mean(), t, d.mean() / d.std(ddof=1)])
    assert r.t_p == pytest.approx(D.t_p_value(t, 34), abs=1e-6)
    half = D.t_quantile(0.975, [34])[0] * d.std(ddof=1) / np.sqrt(35)
    assert [r.ci_low, r.ci_high] == pytest.approx([d.mean() - half, d.mean() + half], rel=1e-4)
    pooled, hits = np.concatenate([a, b]), 0
    for _ in range(2000):
        p = rng.permutation(pooled)
        hits += abs(p[:40].mean() - p[40:].mean()) >= abs(a.mean() - b.mean())
    assert r.permutation_p == pytest.approx(hits / 2000, abs=0.04)
    draws = rng.choice(d, (2000, 35)).mean(axis=1)
    assert [r.boot_low, r.boot_high] == pytest.approx(np.percentile(draws, [2.5, 97.5]), abs=0.2)
    assert r.summary.startswith(f"A {a.mean():.2f} ± {a.std(ddof=1):.2f} (n=40)") and f"({r.label})" in r.summary


FLOW = [
    ("AtoA", 50.0, 0.01, {k: 1.0 for k in S.FEATURES}, {k: 5.0 for k in S.FEATURES}, {k: 50.0 for k in S.FEATURES}),
    ("AtoB", 200.0, 0.2, {k: 1.0 for k in S.FEATURES}, {k: 50.0 for k in S.FEATURES}, {"alpha_rel": 200.0}),
    ("AtoC", None, 0.0, {}, {}, {}),
]


def test_report_has_findings_conclusions_and_suggestions(spark):
    kind = "recording_id string, recovery_time double, artifact_ratio double, baseline_means map<string,double>, attenuation map<string,double>, recovery_per_feature map<string,double>"
    got = {}
    for r in pipelines.report(spark.createDataFrame(FLOW, kind)).orderBy("recording_id", "line_no").collect():
        got.setdefault(r.recording_id, []).append(r.line)
    assert set(got) == {"AtoA", "AtoB", "AtoC"}
    b = got["AtoB"]
    assert b[:3] == ["## AtoB", "Recovery: 200 s, slow", "Artifacts: 20.0 %"]
    assert [x.split(" | ")[0] for x in b[5:11]] == [f"| {k}" for k in S.FEATURES]
    assert "| alpha_rel | 1.0000 | 50.0 | 200 |" in b and "| gamma_rel | 1.0000 | 50.0 | - |" in b
    at = b.index("### Conclusions")
    assert b[at + 1 : at + 5] == ["- recovery is slow", "- flow indicators: drop marked", "- load indicators: rise marked", "- recovery is longer than in the control"]
    assert b[b.index("### Suggestions") + 1 :] == ["- buffer", "- fewer switches", "- rest"]
    assert not any("control" in x for x in got["AtoA"]) and got["AtoA"][-1] == "- keep pace"
    assert "Recovery: not recovered" in got["AtoC"]


def test_five_modules_of_a_study_and_their_failures(spark):
    samples, events = pipelines.study(spark, 700.0, 50, 1)
    keep = samples.where("recording_id IN ('AtoA', 'AtoB')")
    short = spark.createDataFrame([("short", i, i / 50, 0, "ch0", float(i % 7)) for i in range(5)], samples.schema)
    got = {(r.recording_id, r.module): (r.status, r.error) for r in pipelines.batch(keep.unionByName(short), events.where("recording_id <> 'AtoB' OR event_id <> 'X0'"), 50.0).collect()}
    assert set(got) == {(r, m) for r in ("AtoA", "AtoB", "short") for m in pipelines.MODULES}
    assert all(got["AtoA", m] == ("ok", None) for m in ("spectrum", "event_average", "time_frequency", "artifact"))
    assert got["short", "event_average"] == ("failed", "no result") and got["short", "spectrum"][0] == "failed"
    assert got["AtoB", "event_average"][0] == "failed" and got["AtoB", "artifact"] == ("ok", None)


def test_models_are_kept_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(*map(float, x), float(x[0] > x[2])) for x in rng.uniform(0, 1, (200, 6))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*S.BANDS, "variance", "target"]))
    seen = []
    model = learning.classifier(df, progress=seen.append)
    assert len(seen) > 2 and seen[-1]["loss"] < seen[0]["loss"]
    learning.save_model(model, str(tmp_path / "m"))
    got = learning.predicted(learning.load_model(str(tmp_path / "m")), df).collect()
    assert np.mean([r.prediction == r.target for r in got]) > 0.9 and all((r.probability > 0.5) == (r.prediction == 1) for r in got)


def test_bundle_holds_report_results_and_originals(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x\n0,1\n")
    originals = spark.read.format("binaryFile").load(str(tmp_path))
    data = writers.bundle(spark.createDataFrame([("a", float("inf"))], "condition string, x double"), "# r", originals)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert sorted(z.namelist()) == ["files/a.csv", "report.md", "results.json"]
        assert z.read("files/a.csv") == b"time,x\n0,1\n" and json.loads(z.read("results.json")) == [{"condition": "a", "x": None}]
    with pytest.raises(ValueError):
        writers.bundle(spark.createDataFrame([("a", 1.0)], "condition string, x double"), "# r", originals, most_bytes=5)


def test_summary_table(spark):
    df = spark.createDataFrame([("AtoA", 5.0, 0.1, 1)], "condition string, recovery_time double, artifact_ratio double, more int")
    assert [tuple(r) for r in writers.summary_export(df).collect()] == [("AtoA", 5.0, 0.1)]
    assert df.select(F.lit(1)).count() == 1


@pytest.mark.parametrize("name", ["a36_whole_comparison", "x04_study_report", "f06_predicted_windows", "x13_distance_surface", "f07_topography"])
def test_queries_over_tables(spark, name):
    from wavelake.plans import registry

    got = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    if name == "a36_whole_comparison":
        o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderstatus IN ('O', 'F')").toPandas().sort_values("o_orderkey")
        for r in got:
            part = o[o["o_orderpriority"] == r.metric]
            a, b = (part[part["o_orderstatus"] == s]["o_totalprice"].to_numpy(float) for s in "OF")
            n = min(len(a), len(b))
            assert (r.n_a, r.n_b, r.df) == (len(a), len(b), n - 1) and r.mean_diff == pytest.approx((a[:n] - b[:n]).mean(), abs=1e-4)
    elif name == "x04_study_report":
        assert sum(r.line.startswith("## ") for r in got) == 5 and sum("control" in r.line for r in got) == 4
    elif name == "f06_predicted_windows":
        assert np.mean([r.target == r.prediction for r in got]) > 0.7
    elif name == "x13_distance_surface":
        assert len(got) == 900
        values = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("embedding").toPandas()["embedding"]
        means = np.stack(values).astype(float).reshape(len(values), 8, 8).mean(axis=(0, 1))
        at = [pipelines.POSITIONS[c] for c in ["Fp1", "Fp2", "C3", "C4", "Pz", "O1", "O2", "Fz"]]
        for r in got[::97]:
            w = np.array([1 / max(np.hypot(r.x - x, r.y - y), 1e-9) ** 2 for x, y in at])
            assert r.z == pytest.approx((w * means).sum() / w.sum(), abs=1e-5)
    else:
        assert len(got) == 900
