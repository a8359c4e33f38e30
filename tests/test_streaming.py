"""Streams: what is new, what waits, what a rerun adds, and that neither state nor parts grow."""

import json

import pytest
from pyspark.sql import functions as F

from zoneforge.functions.storage import listed
from zoneforge.sources import store
from zoneforge.streaming import jobs
from zoneforge.streaming.epochs import EpochTable, SeenKeys


def pick(batch, unseen):
    novel = unseen(batch.select("key").distinct())
    return {"zone": batch.join(novel, "key").selectExpr("xxhash64(assembly_id, key) AS zone_id", "assembly_id", "key"), "novel_key": novel}


def test_stream_pick_remembers_keys_and_whole_assemblies(spark, tmp_path):
    src, dst, schema = f"file://{tmp_path}/src", f"file://{tmp_path}/dst", "assembly_id long, key string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        return sorted((x.assembly_id, x.key) for x in jobs.stream_pick(spark, src, dst, pick, schema).collect())

    assert arrive((1, "a"), (2, "b")) == [(1, "a"), (2, "b")]
    assert arrive((3, "a"), (3, "c"), (4, "c")) == [(1, "a"), (2, "b"), (3, "c"), (4, "c")]
    assert len(jobs.stream_pick(spark, src, dst, pick, schema).collect()) == 4
    with pytest.raises(Exception, match="two batches"):
        arrive((2, "z"))


def test_an_assembly_waits_until_it_is_whole(spark, tmp_path):
    src, dst, schema = f"file://{tmp_path}/src", f"file://{tmp_path}/dst", "assembly_id long, key string, n_atoms long"
    sizes = []

    def counted(batch, unseen):
        sizes.append({r.assembly_id: r["count"] for r in batch.groupBy("assembly_id").count().collect()})
        return pick(batch, unseen)

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        found = jobs.stream_pick(spark, src, dst, counted, schema, total="n_atoms")
        return [] if found is None else sorted((x.assembly_id, x.key) for x in found.collect())

    assert arrive((1, "a", 3), (2, "b", 1)) == [(2, "b")]
    assert arrive((1, "b", 3), (3, "a", 2)) == [(2, "b")]
    assert arrive((1, "c", 3)) == [(1, "a"), (1, "c"), (2, "b")]  # b was seen before it was whole
    assert arrive((3, "d", 2)) == [(1, "a"), (1, "c"), (2, "b"), (3, "d")]
    assert sizes == [{2: 1}, {1: 3}, {3: 2}]
    with pytest.raises(Exception, match="more atoms than it said"):
        arrive((1, "z", 3))
    assert spark.conf.get(jobs._PROVIDER, "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider")


def response(pdb_id, accession):
    return {"pdb_id": pdb_id, "http_status": 200, "payload": json.dumps({"results": [{"metadata": {"accession": accession, "type": "domain"}}]})}


def test_annotations_keep_no_state_and_few_parts(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    src, dst, queries = f"file://{tmp_path}/src", f"file://{tmp_path}/dst", []
    run = jobs._run
    monkeypatch.setattr(jobs, "_run", lambda writer: queries.append(run(writer)))
    for k in range(20):
        rows = [response(f"p{k}", f"IPR{k}"), response(f"p{k // 2}", "late")]
        (tmp_path / f"src/{k:02d}.json").write_text("\n".join(map(json.dumps, rows)))
    found = {r.pdb_id: r.interpro_id for r in jobs.stream_annotations(spark, src, dst, files=1).collect()}
    assert len(found) == 20 and all(found[f"p{k}"] in (f"IPR{k}", "late") for k in range(20)) and sum(v == "late" for v in found.values()) <= 1
    again = jobs.stream_annotations(spark, src, dst, files=1)
    assert again.count() == 20
    assert all(p["stateOperators"] == [] for q in queries for p in q.recentProgress)
    assert len(listed(spark, f"{dst}/data")) <= 17 and len(listed(spark, f"{dst}/seen")) <= 17


def test_curriculum_adds_deltas(spark, tmp_path):
    src, dst = f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    want = {}
    for k in range(19):
        rows = [(z, k, float(z * k % 7)) for z in range(k, k + 4)]
        for z, _, d in rows:
            want.setdefault(z, []).append(d)
        spark.createDataFrame(rows, "zone_id long, random_seed long, difficulty double").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        found = {r.zone_id: (r.difficulty, r.n) for r in jobs.stream_curriculum(spark, src, dst=dst, files=1).collect()}
        assert found == {z: (pytest.approx(sum(v) / len(v)), len(v)) for z, v in want.items()}
    table = EpochTable(spark, f"{dst}/sums")
    assert len(listed(spark, f"{dst}/sums")) <= 17 and table._parts()[0] >= 15
    assert spark.read.parquet(f"{dst}/sums/epoch-18").count() == 4


def test_an_epoch_that_is_run_again_sees_what_it_saw(spark, tmp_path):
    seen = SeenKeys(spark, f"file://{tmp_path}/s", "key", buckets=4, every=2)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = lambda rows, e: sorted(r.key for r in seen.unseen(rows, e).collect())
    for epoch, (new, fresh) in enumerate([(("a", "b"), ["a", "b"]), (("b", "c"), ["c"]), (("a", "c", "d"), ["d"]), (("d", "e"), ["e"]), (("e", "a", "f"), ["f"])]):
        assert got(keys(*new), epoch) == fresh
        seen.put(keys(*new), epoch)
        assert got(keys(*new), epoch) == fresh
    assert len(listed(spark, f"file://{tmp_path}/s")) <= 4


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    zone = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "zone_id long, assembly_id long")
    child = lambda *ids: spark.createDataFrame([(i, "A", 0) for i in ids], "zone_id long, subchain_id string, symmetry_mate int")
    assert store.write_dataset({"zone": zone(1, 2), "subchain": child(1)}, path) == 1
    broken = child(3).withColumn("subchain_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.write_dataset({"zone": zone(2, 3), "subchain": broken}, path)
    ids = lambda name="zone", version=None: sorted(r.zone_id for r in store.read_table(spark, path, name, version).collect())
    assert ids() == [1, 2] and store.manifest(spark, path)["version"] == 1
    assert store.write_dataset({"zone": zone(2, 3), "subchain": child(3)}, path) == 2
    assert store.write_dataset({"zone": zone(2, 3), "subchain": child(3)}, path) is None
    assert ids() == [1, 2, 3] and ids(version=1) == [1, 2] and ids("subchain") == [1, 3]
    (tmp_path / f"s/versions/{3:012d}.json").write_text('{"version": 3, "tab')  # a writer that died in its manifest
    assert ids() == [1, 2, 3] and store.write_dataset({"zone": zone(4)}, path) == 4 and ids() == [1, 2, 3, 4]
    assert store.compact(spark, path, 1) == 5 and ids() == [1, 2, 3, 4] and store.compact(spark, path, 1) is None
    assert store.vacuum(spark, path) > 0 and ids() == [1, 2, 3, 4] and len(listed(spark, f"{path}/versions")) == 1
    assert store.read_table(spark, path, "none") is None
    with pytest.raises(KeyError):
        store.manifest(spark, path, 1)


def test_a_writer_that_comes_second_builds_again(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tries = []

    def build(read, base):
        tries.append(base["version"])
        if len(tries) == 1:  # another writer comes first
            store.write_dataset({"zone": spark.createDataFrame([(0, 1)], "zone_id long, assembly_id long")}, path)
        return {"zone": spark.createDataFrame([(store.next_id(read("zone"), "zone_id"), 2)], "zone_id long, assembly_id long")}

    assert store.transact(spark, path, build) == 2 and tries == [0, 1]
    assert sorted((r.zone_id, r.assembly_id) for r in store.read_table(spark, path, "zone").collect()) == [(0, 1), (1, 2)]
    def outrun(read, base):
        other = store.next_id(read("zone"), "zone_id")
        store.write_dataset({"zone": spark.createDataFrame([(other, 3)], "zone_id long, assembly_id long")}, path)
        return {"zone": spark.createDataFrame([(other, 4)], "zone_id long, assembly_id long")}

    with pytest.raises(store.Conflict):
        store.transact(spark, path, outrun, attempts=2)
