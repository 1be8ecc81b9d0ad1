import pytest
from pyspark.sql import functions as F

from loomfed.operators import federated
from loomfed.plans import snapshot as snapshots
from loomfed.plans.module import Compiler, Module, PeerPolicy, PlanError, union_of_status
from loomfed.sources import tables


def test_modules_compose_compile_and_run(spark):
    seen = []
    double = Module("double", lambda t, r: {"out": t["x"].withColumn("v", F.col("v") * 2)})
    body = lambda t, r: {"out": r["aggregator"](double.call({"x": t["x"]}, r)["out"])}
    module = Module("round", body, {"x": tables.SCHEMAS["contributions"]}, ("aggregator",), lambda roles: seen.append(1))
    with pytest.raises(PlanError, match="aggregator"):
        Compiler().compile(module)
    with pytest.raises(PlanError, match="no role"):
        Compiler().bind("cook", None)
    compiler = Compiler().bind("aggregator", federated.aggregate).push_stage("keep", lambda d: d).insert_stage(0, "plus", lambda d: d.withColumn("v", F.col("v") + 1)).remove_stage("keep")
    plan = compiler.compile(module)
    x = spark.createDataFrame([(1, "a", 1, 0, 3.0, 1)], tables.SCHEMAS["contributions"])
    assert plan.invoke(x=x)["out"].first()["v"] == 7.0
    plan.invoke(x=x)
    assert seen == [1]
    with pytest.raises(PlanError, match="missing"):
        plan.invoke()
    with pytest.raises(PlanError, match="seq"):
        plan.invoke(x=x.withColumn("seq", F.lit("text")))


def test_peer_policy_and_status(spark):
    policy = PeerPolicy(spark)
    policy.block_peer("a")
    policy.block_peer("b")
    policy.unblock_peer("a")
    assert [r[0] for r in policy.blocklist().collect()] == ["b"] and policy.allowlist() is None
    policy.set_allowlist({"c"})
    both = union_of_status(("blocked", policy.blocklist()), ("allowed", policy.allowlist()))
    assert both.filter("kind = 'allowed'").first()["payload"] == '{"peer":"c"}'


def test_snapshots_round_trip(spark, tmp_path):
    registry = spark.createDataFrame([("a", 5, 95), ("b", 6, 96)], "peer string, last_ns long, expires_ns long")
    log = spark.createDataFrame([("a", 1), ("b", 2)], "peer string, ts_ns long")
    path = str(tmp_path / "one")
    snapshots.snapshot(spark, {"registry": registry, "log": log, "empty": log.limit(0)}, path)
    back = snapshots.restore(spark, path)
    assert set(back) == {"registry", "log", "empty"} and back["empty"].count() == 0
    assert back["registry"].schema == registry.schema and sorted(map(tuple, back["registry"].collect())) == sorted(map(tuple, registry.collect()))
    later = snapshots.resume(back["log"], spark.createDataFrame([("b", 2), ("c", 3)], log.schema))
    assert sorted(map(tuple, later.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(snapshots.SnapshotError, match="whole"):
        snapshots.restore(spark, str(tmp_path / "none"))
    with pytest.raises(snapshots.SnapshotError, match="names"):
        snapshots.snapshot(spark, {"a/b": log}, str(tmp_path / "two"))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    tables.write(df, str(tmp_path / fmt), fmt)
    back = tables.read(spark, str(tmp_path / fmt), fmt, "id long, name string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_unknown_tables_and_missing_schemas_are_refused(spark):
    with pytest.raises(ValueError, match="no table"):
        tables.table(spark, "/x", "nope")
    with pytest.raises(ValueError, match="schema"):
        tables.read(spark, "/x", "csv")
