"""The store of artifacts says what it found; the queue is sorted; corrections by what is stated."""

from tessellum.operators import artifacts


def test_store_and_queue(spark, tmp_path):
    store = artifacts.Artifacts(spark, str(tmp_path / "a"))
    store.save(spark.createDataFrame([(k, k % 2, "door", 0.5, k / 10) for k in range(6)], "artifact_id long, image_id long, component string, confidence double, priority double"))
    told = store.update(spark.createDataFrame([(1, None), (9, "x")], "artifact_id long, component string"))
    assert sorted(map(tuple, told.collect())) == [(1, True), (9, False)]
    one = store.all().where("artifact_id = 1").first()
    assert one.component is None and one.confidence == 0.5 and store.all(1).count() == 3
    told = store.review(spark.createDataFrame([(5, None, "fine"), (8, False, None)], "artifact_id long, approved boolean, notes string"))
    assert sorted(map(tuple, told.collect())) == [(5, True), (8, False)] and store.all().where("approved").count() == 1
    assert [r.artifact_id for r in artifacts.queue(store.all()).collect()] == [4, 3, 2, 1, 0]
    assert [r.artifact_id for r in artifacts.queue(store.all(), pending_only=False).collect()][0] == 5
    assert sorted(map(tuple, store.delete(spark.createDataFrame([(4,), (77,)], "artifact_id long")).collect())) == [(4, True), (77, False)]
    assert store.all().count() == 5


def test_corrections(spark):
    rows = spark.createDataFrame([(1, "ann", "a"), (1, "bob", "a"), (2, "ann", None)], "artifact_id long, engineer string, field string")
    assert artifacts.corrections(rows, artifact=1, engineer="ann").count() == 1 and artifacts.corrections(rows).count() == 3
    assert sorted(((r.kind, r.name, r.n) for r in artifacts.correction_counts(rows).collect()), key=str) == [("engineer", "ann", 2), ("engineer", "bob", 1), ("field", "a", 2), ("field", None, 1)]
