"""The work manifest: versions, two writers, resuming."""

import pytest

from quadrille.sources import manifest as m

WANTED = "job_key string, unit_type string, input_fingerprint string, param_hash string, dependencies array<string>"


def test_one_of_two_writers_loses(spark, tmp_path):
    folder = f"file://{tmp_path}/manifest"
    base, units = m.read(spark, folder)
    assert base == 0 and units.count() == 0
    wanted = spark.createDataFrame([("a", "convert", "f1", "p", []), ("b", "rebuild", "f2", "p", ["a"])], WANTED)
    first = m.prepared(units, wanted, 10)
    assert m.commit(spark, folder, first, 0, "start") == 1
    version, held = m.read(spark, folder)
    running = m.marked(held, spark.createDataFrame([("a", "running", None)], "job_key string, new_status string, checksum string"), 20)
    failed = m.marked(held, spark.createDataFrame([("a", "failed", None)], "job_key string, new_status string, checksum string"), 21)
    assert m.commit(spark, folder, running, version) == 2
    with pytest.raises(m.ManifestConflict):
        m.commit(spark, folder, failed, version)
    # The loser leaves nothing, and earlier versions stay.
    assert m.versions(spark, folder) == [1, 2] and len(list((tmp_path / "manifest/data").iterdir())) == 2
    assert {r.job_key: r.status for r in m.read(spark, folder)[1].collect()} == {"a": "running", "b": "pending"}
    assert {r.status for r in m.read(spark, folder, 1)[1].collect()} == {"pending"}
    # A claim without an entry is a writer that is at it, or was lost: the version isn't given away twice.
    (tmp_path / "manifest/log" / f"{3:020d}.json.claim").touch()
    with pytest.raises(m.ManifestConflict):
        m.commit(spark, folder, failed, 2)
    with pytest.raises(m.ManifestConflict):
        m.commit(spark, folder, failed, 7)
    assert m.release(spark, folder, 3) and not m.release(spark, folder, 3) and not m.release(spark, folder, 2)
    assert m.commit(spark, folder, failed, 2) == 3


def test_resuming_runs(spark):
    old = [("same", "convert", "succeeded", 1, "f", "p", "sum", [], 1), ("input", "convert", "succeeded", 1, "old", "p", "sum", [], 1), ("params", "convert", "succeeded", 1, "f", "old", "sum", [], 1), ("any", "convert", "succeeded", 2, "x", "y", "sum", [], 1), ("run", "convert", "running", 3, "f", "p", None, [], 1), ("fail", "convert", "failed", 4, "f", "p", None, [], 1), ("gone", "convert", "succeeded", 1, "f", "p", "sum", [], 1), ("blank", "convert", "succeeded", 1, None, None, "sum", [], 1)]
    wanted = [("same", "f", "p"), ("input", "f", "p"), ("params", "f", "p"), ("any", None, None), ("run", "f", "p"), ("fail", "f", "p"), ("new", "f", "p"), ("blank", "f", "p")]
    units = spark.createDataFrame(old, m.UNITS)
    got = m.prepared(units, spark.createDataFrame([(k, "convert", f, p, []) for k, f, p in wanted], WANTED), 99)
    rows = {r.job_key: (r.status, r.attempts, r.input_fingerprint, r.output_checksum, r.last_updated_ms) for r in got.collect()}
    assert rows == {"same": ("succeeded", 1, "f", "sum", 1), "input": ("pending", 1, "f", None, 99), "params": ("pending", 1, "f", None, 99), "any": ("succeeded", 2, "x", "sum", 1), "run": ("pending", 3, "f", None, 99), "fail": ("failed", 4, "f", None, 99), "new": ("pending", 0, "f", None, 99), "blank": ("pending", 1, "f", None, 99)}
    chain = spark.createDataFrame([("a", "c", "succeeded", 1, None, None, None, [], 1), ("b", "c", "pending", 0, None, None, None, ["a"], 1), ("c", "c", "failed", 0, None, None, None, ["a", "b"], 1), ("d", "c", "pending", 0, None, None, None, ["zzz"], 1)], m.UNITS)
    assert [r.job_key for r in m.ready(chain).collect()] == ["b"]
    after = {r.job_key: r for r in m.marked(chain, spark.createDataFrame([("b", "running", None), ("c", "succeeded", "s")], "job_key string, new_status string, checksum string"), 5).collect()}
    assert (after["b"].attempts, after["b"].status, after["b"].last_updated_ms) == (1, "running", 5) and after["c"].output_checksum == "s" and after["a"].last_updated_ms == 1
