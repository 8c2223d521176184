import json

import pytest
from pyspark.sql import functions as F

from pairsieve.catalog import inputs as I
from pairsieve.operators.scoring import ScorerRegistry, score_pairs
from pairsieve.plans.study import RedundantSetMissing, StudySettings, evaluate, relabel, section_study
from pairsieve.session import scratch_path, shared_folder
from pairsieve.sources import features as FE
from pairsieve.sources import records as RE
from pairsieve.sources.redundant_sets import lookup_redundant_set, save_redundant_set


def test_read_records_by_extension(spark, tmp_path):
    rows = [{"a": 1, "b": 'say "hi",\nthen go'}, {"a": 2, "b": ""}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "x.csv").write_text('a,b\n1,"say ""hi"",\nthen go"\n2,\n')
    for name in ("x.json", "x.jsonl"):
        got = RE.read_records(spark, str(tmp_path / name)).orderBy("a").collect()
        assert [(r.a, r.b) for r in got] == [(1, rows[0]["b"]), (2, "")]
    got = RE.read_records(spark, str(tmp_path / "x.csv")).orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [("1", rows[0]["b"]), ("2", "")]
    with pytest.raises(ValueError, match="unrecognised"):
        RE.read_records(spark, str(tmp_path / "x.pkl"))


def test_report_json_writes_nulls(spark):
    df = spark.sql("select cast(null as double) accuracy_redundant, named_struct('total', 3L) counts")
    assert json.loads(RE.report_json(df).first().report) == {"accuracy_redundant": None, "counts": {"total": 3}}


def test_load_matrix_checks_lengths(spark):
    path = scratch_path(spark, "m")
    spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "example_num bigint, features array<double>").write.parquet(path)
    assert dict(FE.load_matrix(spark, path).dtypes)["features"] == "array<float>"
    path = scratch_path(spark, "m")
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "example_num bigint, features array<double>")
    bad.coalesce(1).write.parquet(path)
    with pytest.raises(Exception, match="expected 2 components"):
        FE.load_matrix(spark, path).collect()


def test_features_are_reused_only_when_complete(spark, small):
    root = scratch_path(spark, "f")
    calls = []

    def compute():
        calls.append(1)
        return score_pairs(I.feats(spark, small), I.FIRST_SCORER)

    assert FE.usable_features(spark, root, "m", "full") is None
    first = FE.reuse_or_compute(spark, root, "m", "full", compute)
    again = FE.reuse_or_compute(spark, root, "m", "full", compute)
    assert len(calls) == 1 and first.count() == again.count() == 250
    FE.reuse_or_compute(spark, root, "m", "full", compute, force=True)
    FE.reuse_or_compute(spark, root, "m", "full", compute, skip_cache=True)
    assert len(calls) == 3
    broken = compute().withColumn("score_chosen", F.when(F.col("example_num") > 3, F.col("score_chosen")))
    FE.save_features(broken, root, "m", "partial")
    assert FE.usable_features(spark, root, "m", "partial") is None
    assert FE.usable_features(spark, root, "m", "full").count() == 250  # other partitions stay
    assert FE.read_features(spark, root, "m", "full", correct_only=True).count() < 250


def test_redundant_sets_by_key(spark):
    root = scratch_path(spark, "r")
    with pytest.raises(RedundantSetMissing):
        lookup_redundant_set(spark, root, "gold", "safety", "nnls", 0.95)
    df = spark.createDataFrame([(0, True), (1, False)], "example_num bigint, is_redundant boolean")
    save_redundant_set(df, root, "gold", "safety", "nnls", 0.95)
    save_redundant_set(df.limit(1), root, "gold", "safety", "nnls", 0.8)
    assert lookup_redundant_set(spark, root, "gold", "safety", "nnls", 0.95).count() == 2
    assert lookup_redundant_set(spark, root, "gold", "safety", "nnls", 0.8).count() == 1
    with pytest.raises(RedundantSetMissing):
        lookup_redundant_set(spark, root, "gold", "chat", "nnls", 0.95)


def test_study_without_gold_result(spark, small):
    registry = ScorerRegistry({}, default=I.FIRST_SCORER)
    roots = {"features": scratch_path(spark, "f"), "redundant": scratch_path(spark, "r")}
    settings = StudySettings("gold", components=4)
    examples = I.feats(spark, small).drop("f_diff")
    with pytest.raises(RedundantSetMissing):
        section_study(examples, I.sections(spark), registry, ["other"], "safety", roots, settings)
    section_study(examples, I.sections(spark), registry, ["gold"], "safety", roots, settings)
    report = section_study(examples, I.sections(spark), registry, ["other"], "safety", roots, settings).first()
    assert report.model == "other" and report.counts.total == report.counts.redundant + report.counts.non_redundant


def test_evaluation_only(spark, small):
    scored = I.pairs(spark, small)
    out = evaluate(relabel(scored, scored), I.sections(spark).select("section", "subset", "example_count"))
    assert out["overall"].first().n_pairs == 250 and out["subsets"].count() == 10
    assert out["sections"].count() == 4 and out["coverage"].first().is_complete


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
