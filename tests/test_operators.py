"""Operators on small inputs with known answers."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import dedup, gap, grid, kdtree, merge, quadtree, running, tasks, tree, validate
from quadrille.plans import registry
from quadrille.sources import scan, tileset
from tests import oracle


def square_blocks(spark, n, x0=0, y0=0, skip=()):
    rows = [(f"b{x}_{y}", x0 + x, y0 + y, x * 100.0 - 50, y * 100.0 - 50, -10.0, x * 100.0 + 50, y * 100.0 + 50, 10.0, x * 100.0, y * 100.0) for x in range(n) for y in range(n) if (x, y) not in skip]
    return spark.createDataFrame(rows, "block_id string, gx int, gy int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, cx double, cy double")


def test_levels_of_grids(spark):
    count = lambda df, **k: [r.n_nodes for r in quadtree.level_counts(df, **k).orderBy("level").collect()]
    assert count(square_blocks(spark, 4)) == [16, 4, 1]
    assert count(square_blocks(spark, 16)) == [256, 64, 16, 4, 1]
    assert count(square_blocks(spark, 16, x0=-7, y0=33)) == [256, 64, 16, 4, 1]
    assert count(square_blocks(spark, 4), max_level=1) == [16, 4]
    assert count(square_blocks(spark, 2, skip={(1, 1)})) == [3, 1]
    sparse = spark.createDataFrame([("a", 0, 0), ("b", 9, 9)], "block_id string, gx int, gy int")
    assert [r.shrinks for r in quadtree.level_counts(sparse).orderBy("level").collect()] == [True, False, False, False, True]
    kids = {(r.level, r.gx, r.gy): list(r.child_ids) for r in quadtree.child_lists(square_blocks(spark, 4)).collect()}
    assert kids[1, 0, 0] == ["L0_b0_0", "L0_b1_0", "L0_b0_1", "L0_b1_1"] and kids[2, 0, 0] == ["Proxy_L1_0_0", "Proxy_L1_1_0", "Proxy_L1_0_1", "Proxy_L1_1_1"]
    assert quadtree.level_counts(square_blocks(spark, 1)).count() == 1 and quadtree.level_counts(square_blocks(spark, 0)).count() == 0


def test_levels_equal_the_loop_on_random_grids(spark):
    rng = random.Random(4)
    cells = {(rng.randrange(-9, 9), rng.randrange(-9, 9)) for _ in range(40)}
    df = spark.createDataFrame([(f"{x},{y}", x, y) for x, y in cells], "block_id string, gx int, gy int")
    x0, y0 = min(x for x, _ in cells), min(y for _, y in cells)
    now, want = {(x - x0, y - y0) for x, y in cells}, []
    while True:
        want.append(len(now))
        if len(now) == 1:
            break
        now = {(x // 2, y // 2) for x, y in now}
    assert [r.n_nodes for r in quadtree.level_counts(df).orderBy("level").collect()] == want


def test_selection(spark):
    reps = spark.createDataFrame([("a", 0, 50.0), ("a", 1, 20.0), ("a", 2, 10.0), ("b", 0, 90.0), ("b", 1, 60.0), ("b", 2, 60.0), ("c", 0, 40.0), ("c", 1, 40.0)], "block_id string, rep_index int, ge double")
    got = {r.block_id: (r.rep_index, r.ge, r.reached) for r in quadtree.select_representations(reps, 100.0).collect()}
    assert got == {"a": (0, 50.0, True), "b": (1, 60.0, False), "c": (0, 40.0, True)}
    assert quadtree.default_target(reps).first()[0] == 180.0


def test_grid_checks(spark):
    full = square_blocks(spark, 3)
    assert grid.completeness(full).first().complete and grid.missing_cells(full).count() == 0
    holed = square_blocks(spark, 3, skip={(2, 2)})
    assert not grid.completeness(holed).first().complete and [tuple(r) for r in grid.missing_cells(holed).collect()] == [(2, 2)]
    assert all(r.within for r in grid.residuals(full).collect())
    shifted = full.withColumn("cx", F.when(F.col("block_id") == "b1_1", F.col("cx") + 80).otherwise(F.col("cx")))
    assert [r.block_id for r in grid.residuals(shifted).collect() if not r.within] == ["b1_1"]
    same = full.withColumn("cx", F.lit(5.0)).withColumn("cy", F.lit(5.0))
    assert grid.cell_sizes(same).first().collapsed and not grid.cell_sizes(full).first().collapsed


def write_tilesets(folder):
    cube = {"box": [0, 0, 0, 50, 0, 0, 0, 50, 0, 0, 0, 10]}
    root = {"asset": {"version": "1.0"}, "geometricError": 400, "root": {"boundingVolume": cube, "geometricError": 400, "refine": "ADD", "children": []}}
    for x in range(2):
        for y in range(2):
            name = f"Tile_+00{x}_+00{y}"
            (folder / "Data" / name).mkdir(parents=True)
            move = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x * 100, y * 100, 0, 1]
            root["root"]["children"].append({"boundingVolume": cube, "geometricError": 100, "transform": move, "content": {"uri": f"./Data/{name}/tileset.json"}})
            fine = {"boundingVolume": cube, "geometricError": 10, "content": {"uri": f"{name}_L1.b3dm"}}
            block = {"asset": {"version": "1.0"}, "geometricError": 50, "root": {"boundingVolume": cube, "geometricError": 50, "refine": "REPLACE", "content": {"uri": f"{name}.b3dm"}, "children": [fine]}}
            (folder / "Data" / name / "tileset.json").write_text(json.dumps(block))
    (folder / "tileset.json").write_text(json.dumps(root))


def test_tilesets(spark, tmp_path):
    write_tilesets(tmp_path)
    (tmp_path / "bad.json").write_text("{")
    docs = tileset.documents(spark, str(tmp_path))
    tiles = tileset.tiles(docs).cache()
    assert tiles.filter("error IS NULL").count() == 1 + 4 + 4 * 2
    assert [r.error.split(":")[0] for r in tiles.filter("error IS NOT NULL").collect()] == ["TILESET_JSON_INVALID"]
    root = next(r.doc for r in tiles.filter("doc LIKE '%/tileset.json' AND doc NOT LIKE '%Data%'").limit(1).collect())
    blocks = tileset.blocks(tiles, root)
    got = {r.block_id: (r.gx, r.gy, r.min_x, r.max_y) for r in blocks.collect()}
    assert got["Tile_+001_+000"] == (1, 0, 50.0, 50.0) and len(got) == 4
    assert [r.n_nodes for r in quadtree.level_counts(blocks).orderBy("level").collect()] == [4, 1]
    reps = tileset.representations(tiles.filter("error IS NULL"), blocks).collect()
    assert {(r.block_id, r.rep_index, r.ge) for r in reps} >= {("Tile_+001_+001", 0, 50.0), ("Tile_+001_+001", 1, 10.0)} and len(reps) == 8
    assert all(list(r.transform)[12] == 100 * int(r.block_id[8]) for r in reps)
    chosen = {r.block_id: r.rep_index for r in quadtree.select_representations(tileset.representations(tiles.filter("error IS NULL"), blocks), 60.0).collect()}
    assert set(chosen.values()) == {1}
    issues = validate.tile_issues(tileset.with_parents(tiles.filter("error IS NULL AND loc IS NOT NULL")))
    assert issues.filter("severity = 'error'").count() == 0
    contents = tiles.filter("uri IS NOT NULL").select("loc", F.regexp_replace("base", ".*/Data", "Data").alias("base"), "uri")
    contents = contents.withColumn("base", F.when(F.col("base").startswith("Data"), F.col("base")).otherwise(""))
    listing = scan.files(spark, str(tmp_path)).select(F.regexp_replace("path", f"^file:{tmp_path}/", "").alias("path"))
    codes = [r.code for r in validate.content_issues(contents, listing).collect()]
    assert codes == ["CONTENT_MISSING"] * 8
    escape = spark.createDataFrame([("l", "a", "../../x.glb"), ("l", "a", "https://h/x.glb")], "loc string, base string, uri string")
    assert [r.code for r in validate.content_issues(escape, listing).collect()] == ["CONTENT_URI_ESCAPE"] * 2


def test_merge_roots(spark):
    box = [0.0, 0, 0, 50, 0, 0, 0, 50, 0, 0, 0, 10]
    move = [2.0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 10, 0, 0, 1]
    rows = [(1, "a.json", box, None, None, move, 8.0, 4.0, "ADD", "1.0"), (2, "b.json", None, None, [1.0, 2, 3, 5], None, 1.0, 20.0, "REPLACE", "1.1"), (3, "c.json", None, [0.1, 0.1, 0.2, 0.2, 0.0, 10.0], None, None, 1.0, 1.0, None, "1.0")]
    rows = [tuple([float(x) for x in v] if isinstance(v, list) else v for v in r) for r in rows]
    roots = merge.root_bounds(spark.createDataFrame(rows, "source int, file string, box array<double>, region array<double>, sphere array<double>, transform array<double>, ge double, doc_ge double, refine string, version string"))
    got = {r.source: (list(r.bounds), r.error) for r in roots.collect()}
    assert got[1] == ([-90.0, -100, -20, 110, 100, 20], 16.0) and got[2] == ([-4.0, -3, -2, 6, 7, 8], 20.0)
    assert [(r.source, r.why[:37]) for r in merge.root_issues(roots).collect()] == [(3, "merge input root requires explicit re")]
    doc = json.loads(merge.merged_root(roots.filter("source < 3")).first()[0])
    assert doc["asset"]["version"] == "1.1" and doc["geometricError"] == 20 and doc["root"]["refine"] == "ADD"
    assert [c["content"]["uri"] for c in doc["root"]["children"]] == ["sources/source-001/a.json", "sources/source-002/b.json"]
    assert doc["root"]["boundingVolume"]["box"][0] == 10.0


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    flat = {r.id: (r.depth, list(r.path)) for r in tree.flatten(nodes).collect()}
    assert flat == {"r": (0, ["r"]), "a": (1, ["r", "a"]), "b": (1, ["r", "b"]), "c": (2, ["r", "a", "c"])}
    bodies = spark.createDataFrame([("r", None, 0, '{"n":1}'), ("a", "r", 1, "{}"), ("b", "r", 1, '{"n":2}'), ("c", "a", 2, '{"n":3}')], "id string, parent_id string, depth int, body string")
    assert json.loads(tree.emit(bodies).first().json) == {"n": 1, "children": [{"children": [{"n": 3}]}, {"n": 2}]}
    ge = spark.createDataFrame([("r", None, 10.0), ("a", "r", 12.0), ("b", "r", 10.0)], "id string, parent_id string, ge double")
    assert [r.id for r in tree.error_violations(ge).collect()] == ["a"]


def test_headers(spark):
    table = b'{"BATCH_LENGTH":0} '
    good = b"b3dm" + np.array([1, 28 + 20, 20, 0, 0, 0], "<u4").tobytes() + table.ljust(20)
    rows = [("ok", good), ("short", b"b3dm"), ("version", b"b3dm" + np.array([2, 28, 0, 0, 0, 0], "<u4").tobytes()), ("long", b"b3dm" + np.array([1, 99, 0, 0, 0, 0], "<u4").tobytes()), ("glb", b"glTF" + np.array([2, 12], "<u4").tobytes()), ("what", b"abcdefghijkl"), ("pnts", b"pnts" + b"\0" * 20)]
    got = {r.k: r.i for r in spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k string, v binary").select("k", validate.header_issue(F.col("v")).alias("i")).collect()}
    assert got == {"ok": None, "short": "CONTENT_TOO_SMALL", "version": "CONTENT_INVALID: b3dm version", "long": "CONTENT_INVALID: b3dm byteLength", "glb": None, "what": "CONTENT_INVALID: unknown magic", "pnts": None}


def test_gaps_are_exact(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 100, (60, 3)), rng.uniform(0, 100, (50, 3))
    b[:5] += 400  # far off, so that coarser rounds are needed
    frame = lambda p: spark.createDataFrame([(1, 2, 5.0, i, *map(float, q)) for i, q in enumerate(p)], "a int, b int, cell double, point_id int, x double, y double, z double")
    got = {r.point_id: r.d for r in gap.nearest(frame(a), frame(b), ["a", "b"]).collect()}
    back = {r.point_id: r.d for r in gap.nearest(frame(b), frame(a), ["a", "b"]).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert np.allclose([got[i] for i in range(60)], d.min(1)) and np.allclose([back[i] for i in range(50)], d.min(0))


def squares(a, b):
    d = a[:, None] - b[None]
    return d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2


@pytest.mark.parametrize("limit", [7, 40, 1 << 16])
def test_nearest_in_chunks_equals_brute_force(spark, limit):
    """Sets of several chunks and of one, copies, far outliers, flat sets, and points that share an id or lack a coordinate."""
    rng = np.random.default_rng(12)
    a, b = [rng.normal(size=(n, 3)) for n in (300, 90, 60)], [rng.normal(size=(n, 3)) for n in (400, 150, 5)]
    b[0][:200] = b[0][0]
    b[1][:, 2] = 0.0
    a[1][:30] *= 100
    frame = lambda sets: spark.createDataFrame([(f"s{k}", i, *map(float, q)) for k, p in enumerate(sets) for i, q in enumerate(p)], "k string, point_id long, x double, y double, z double")
    odd = spark.createDataFrame([("s0", 9000, 1.0, None, 2.0), ("s0", 1, *map(float, b[0][7])), ("none", 1, 1.0, 1.0, 1.0)], "k string, point_id long, x double, y double, z double")
    targets = frame(b).union(spark.createDataFrame([("s2", 50, float("nan"), 0.0, 0.0), ("s2", 51, None, 0.0, 0.0)], odd.schema))
    rows = gap.nearest(frame(a).union(odd), targets, ["k"], limit=limit).collect()
    want = {(f"s{k}", i): d for k in range(3) for i, d in enumerate(np.sqrt(squares(a[k], b[k]).min(1)))} | {("s0", 1): 0.0, ("s0", 9000): None}
    assert len(rows) == len(want) and {(r.k, r.point_id): r.d for r in rows} == want


def test_points_look_at_few_of_many_targets(monkeypatch):
    """In two sets of one place and size, where a cell as wide as a set holds all pairs."""
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(500, 3)), rng.normal(size=(20000, 3))
    seen, to_leaf = [], kdtree.Tree.to_leaf
    monkeypatch.setattr(kdtree.Tree, "to_leaf", lambda self, node, at: seen.append(len(node) * self.leaves[0].shape[1]) or to_leaf(self, node, at))
    got = kdtree.Tree(b).nearest(a, np.full(len(a), np.inf))
    assert (got == squares(a, b).min(1)).all() and sum(seen) < 100 * len(a)
    assert (kdtree.Tree(b[:1]).nearest(a[:9], np.full(9, 0.5)) == np.minimum(squares(a[:9], b[:1])[:, 0], 0.5)).all()


@pytest.mark.parametrize("name", ["nearest_border", "gap_p95"])
def test_gaps_of_odd_rows_equal_their_sql(spark, tmp_path, name):
    """Embeddings without some of the numbers, and ids that stand twice."""
    rng = np.random.default_rng(14)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=3)]) for i in range(90)]
    rows += [(200, 0, [0.1, None, 0.2]), (201, 1, [None, 0.1, 0.2]), (202, 2, [0.3]), (203, 1, None), (3, 0, [0.0, 0.0, 0.0]), (4, 1, [0.1, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert oracle.compare(spark, con, name, registry.QUERIES[name], registry.ORACLE[name], str(tmp_path)) is None


def test_percentile_rank(spark):
    for n in (1, 2, 12, 19, 20, 33):
        got = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")).agg(gap.p95(F.col("v"))).first()[0]
        assert got == sorted(range(1, n + 1))[int((n - 1) * 0.95 + 0.5)]


def test_open_borders_have_the_known_gap(spark):
    rows = [(m, i, float(i), 0.5 * m, 0.0) for m in (0, 1) for i in range(10)]
    points = spark.createDataFrame(rows, "mesh int, point_id int, x double, y double, z double")
    pairs = gap.adjacent(gap.boxes(points))
    assert [r.axis for r in pairs.collect()] == ["y"]
    m = gap.overall(gap.gap_metrics(points, pairs)).first()
    assert (m.max_gap, m.p95_gap, m.n_pairs) == (0.5, 0.5, 1)
    assert gap.adjacent(gap.boxes(points), cell=3.0).count() == 1


def test_scan(spark):
    rows = [("/d/Data/Tile_+0_+0/Tile_+0_+0.osgb", 5), ("/d/Data/Tile_+0_+0/x.OSGB", 7), ("/d/Data/Tile_+0_+0/note.txt", 9), ("/d/Data/Tile_1_1/x.osgb", 1), ("/d/Data/other/other.osgb", 2), ("/d/Data/junk/a.txt", 1), ("/d/metadata.xml", 3)]
    folders = scan.tile_folders(spark.createDataFrame(rows, "path string, length long"))
    got = {r.tile: (r.n_osgb, r.bytes, r.has_entry, r.standard) for r in folders.collect()}
    assert got == {"Tile_+0_+0": (2, 12, True, True), "Tile_1_1": (1, 1, False, True), "other": (1, 2, True, False)}
    assert tuple(scan.totals(folders).first()) == (3, 4, 15, 1)
    assert sorted(r.severity for r in scan.scan_issues(folders).collect()) == ["error", "warning"]
    many = spark.range(25).select(F.format_string("Tile_%d_0", "id").alias("tile"), F.lit(False).alias("has_entry"), F.lit(True).alias("standard"))
    said = [r.message for r in scan.scan_issues(many).collect()]
    assert len(said) == 21 and said[-1] == "... and 5 more missing entry files"
    texts = [("a", "<ModelMetadata><SRS>EPSG:4547</SRS><SRSOrigin> 1,2,3 </SRSOrigin></ModelMetadata>"), ("b", "<a><SRS>x</b>"), ("c", "<a><SRS/></a>")]
    meta = {r.path: r for r in scan.metadata(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert (meta["a"].srs, meta["a"].srs_origin, meta["a"].xml_error) == ("EPSG:4547", "1,2,3", None) and meta["b"].srs is None and "mismatched" in meta["b"].xml_error and meta["c"].srs is None


def test_model_references(spark):
    texts = spark.createDataFrame([("/m/a.obj", "mtllib a.mtl\nv 0 0 0\nmtllib gone.mtl"), ("/m/a.mtl", "newmtl x\nmap_Kd tex\\d.png\nbump none.png")], "path string, text string")
    listing = spark.createDataFrame([("/m/a.mtl",), ("/m/d.png",), ("/r/none.png",)], "path string")
    got = {(r.path, r.reference): r.found for r in scan.resolved(scan.model_references(texts), listing, ["/r/"]).collect()}
    assert got == {("/m/a.obj", "a.mtl"): "/m/a.mtl", ("/m/a.obj", "gone.mtl"): None, ("/m/a.mtl", "tex\\d.png"): "/m/d.png", ("/m/a.mtl", "none.png"): "/r/none.png"}


def test_task_store(spark):
    kinds = "id string, status string, stage string, created_at double, updated_at double, finished_at double, cancel_requested boolean"
    store = spark.createDataFrame([("a", "queued", "", 2.0, 2.0, None, False), ("b", "queued", "", 1.0, 1.0, None, True), ("c", "running", "x", 0.0, 0.0, None, False), ("d", "failed", "y", 0.0, 0.0, 1.0, False)], kinds)
    assert tasks.next_queued(store).first().id == "a"
    got = {r.id: (r.status, r.stage, r.finished_at) for r in tasks.mark_interrupted(store, F.lit(9.0)).collect()}
    assert got == {"a": ("interrupted", "interrupted", 9.0), "b": ("interrupted", "interrupted", 9.0), "c": ("interrupted", "x", 9.0), "d": ("failed", "y", 1.0)}
    asked = spark.createDataFrame([("a",), ("c",), ("d",)], "id string")
    assert {r.id: r.status for r in tasks.request_cancel(store, asked, F.lit(9.0)).collect()} == {"a": "cancelled", "b": "queued", "c": "cancelling", "d": "failed"}
    art = "id string, path string, task_id string, kind string, label string, created_at double"
    current = spark.createDataFrame([("1", "/p", "t1", "tiles", "old", 1.0)], art)
    added = spark.createDataFrame([("2", "/p", None, "", "new", 2.0), ("3", "/q", "t2", "log", "", 2.0)], art)
    got = {r.path: (r.id, r.task_id, r.kind, r.label) for r in tasks.register_artifacts(current, added).collect()}
    assert got == {"/p": ("1", "t1", "tiles", "new"), "/q": ("3", "t2", "log", None)}


def test_cache_and_files(spark):
    items = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name string, mtime int")
    cache = spark.createDataFrame([("a", 9), ("b", 1)], "name string, mtime int")
    assert sorted(r.name for r in tasks.stale_cache(items, cache).collect()) == ["b", "c"]
    before = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, fingerprint string")
    after = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, fingerprint string")
    assert {r.path: r.change for r in dedup.file_changes(before, after).collect()} == {"y": "changed", "z": "removed", "w": "added"}
    sizes = spark.createDataFrame([("a", 4096, 2048), ("b", 100, 100)], "hash string, width int, height int")
    assert {r.hash: (r.w, r.h) for r in dedup.shrink_plan(sizes, 10**9, 2048).collect()} == {"a": (2048, 1024), "b": (100, 100)}
    assert all(r.step == 2 for r in dedup.shrink_plan(sizes, 2_200_000, 2048).collect())
    files = spark.createDataFrame([("a", bytearray(b"xx ktx2")), ("b", bytearray(b"none"))], "path string, content binary")
    assert tuple(dedup.evidence(files).first())[:3] == (2, 1, True)


@pytest.mark.parametrize("seed", range(3))
def test_throttle_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for task in range(4):
        at, last, last_at = 0, None, None
        for seq in range(60):
            at += rng.randrange(0, 300)
            done = rng.randrange(0, 4)
            rows.append((task, seq, at, done, 10))
            if last_at is None or (done != last and at - last_at >= 400):
                want.add((task, seq))
                last, last_at = done, at
    rng.shuffle(rows)
    got = tasks.throttle(spark.createDataFrame(rows, "task_id long, seq long, at_ms long, completed long, total long"))
    assert {(r.task_id, r.seq) for r in got.collect()} == want


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes, each shifted by one, with a branch and a cycle beside it."""
    rounds = []
    monkeypatch.setattr(tree, "cut", lambda df, own=tree.cut: (rounds.append(1), own(df))[1])
    n = 100_000
    chain = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    beside = spark.createDataFrame([(n, 5), (n + 1, n + 2), (n + 2, n + 1), (n + 3, 10**9)], "id long, parent_id long")
    step = F.array(*(F.lit(1.0 if i % 5 == 0 or i == 12 else 0.0) for i in range(16)))
    found = tree.with_world(chain.union(beside).withColumn("transform", step))
    bad = found.filter((F.col("id") < n) & ((F.col("depth") != F.col("id")) | (F.get("world", 12) != F.col("id") + 1)))
    assert found.count() == n + 1 and bad.count() == 0 and found.filter(F.col("id") == n).first().depth == 6
    assert len(rounds) - 2 < 20  # two of them come before the rounds
    with pytest.raises(ValueError, match="twice"):
        tree.with_world(spark.createDataFrame([(1, None), (1, None)], "id long, parent_id long").withColumn("transform", step))


def test_flatten_marks_cycles_of_keys_with_several_parents(spark):
    edges = [("r", None), ("a", "r"), ("b", "a"), ("a", "b"), ("b", "r")]
    got = {("/".join(r.path), r.cycle) for r in tree.flatten(spark.createDataFrame(edges, "id string, parent_id string")).collect()}
    assert got == {("r", False), ("r/a", False), ("r/b", False), ("r/a/b", False), ("r/b/a", False), ("r/a/b/a", True), ("r/b/a/b", True)}


def test_running_sums_of_one_key_on_many_tasks(spark):
    rng = random.Random(2)
    rows = [(None if k == 3 else k, i, rng.randrange(10)) for k, n in ((1, 4000), (2, 3), (3, 40)) for i in rng.sample(range(10**6), n)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    got = running.running(df, ["k"], [F.desc("at")], {"upto": F.col("v"), "nth": F.lit(1)}, ranges=16)
    want, sums = [], {}
    for k, at, v in sorted(rows, key=lambda r: -r[1]):
        s, n = sums.get(k, (0, 0))
        sums[k] = s + v, n + 1
        want.append((k, at, v, *sums[k]))
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    whole = running.running(df.drop("k"), [], [F.col("at"), F.col("v")], {"upto": F.col("v")}, ranges=8)
    assert whole.agg(F.max("upto")).first()[0] == sum(r[2] for r in rows)
    assert running.running(df.limit(0), ["k"], [F.col("at")], {"upto": F.col("v")}).collect() == []
    # The ranges of one key are many tasks (where small ones aren't joined again, as here).
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = running.running(df, ["k"], [F.desc("at")], {"upto": F.col("v")}, ranges=16).withColumn("p", F.spark_partition_id()).filter("k = 1")
        assert spread.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_elements_by_rank(spark):
    rng = random.Random(3)
    groups = {"a": [rng.randrange(50) / 7 for _ in range(500)], "b": [1.0], "c": [2.0, 1.0], None: [5.0, 4.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    got = {r.k: r.v for r in running.element(df, ["k"], "v", gap.p95_index).collect()}
    assert got == {k: sorted(vs)[int((len(vs) - 1) * 0.95 + 0.5)] for k, vs in groups.items()}
    assert {r.k: r.median for r in grid.upper_median(df, "k", "v").collect()} == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}
    assert running.element(df, [], "v", lambda n: n - 1).first().v == max(v for vs in groups.values() for v in vs)


def test_gaps_of_grids(spark):
    rng = random.Random(5)
    cells = {(rng.randrange(-3, 9), rng.randrange(4, 12)) for _ in range(30)} | {(-3, 4), (8, 11)}
    cells = {c for c in cells if c[0] not in (2, 3)}
    x, y = [c[0] for c in cells], [c[1] for c in cells]
    want = {(a, b) for a in range(min(x), max(x) + 1) for b in range(min(y), max(y) + 1)} - cells
    df = spark.createDataFrame([*cells, *cells], "gx int, gy int")
    assert sorted(map(tuple, grid.missing_cells(df).collect())) == sorted(want)
    assert grid.missing_cells(df.limit(0)).count() == 0 and grid.missing_cells(spark.createDataFrame([(1, 1)], "gx int, gy int")).count() == 0


def test_adjacent_meshes_of_all_sizes(spark):
    """Boxes whose extents differ by six orders of magnitude, against all pairs."""
    rng = random.Random(8)
    rows = []
    for i in range(160):
        ext = [10 ** rng.uniform(-3, 3) for _ in range(3)]
        scale = max(ext[:2])
        low = [rng.choice([-1, 1]) * rng.uniform(0, 40 * scale) * rng.choice([0.0, 0.05, 1]) for _ in range(3)]
        rows += [(i, 8 * i + k, *(low[j] + (k >> j & 1) * ext[j] for j in range(3))) for k in range(8)]
    boxes = gap.boxes(spark.createDataFrame(rows, "mesh int, point_id int, x double, y double, z double"))
    b = {r.mesh: r.asDict() for r in boxes.collect()}
    want = set()
    for i in b:
        for j in b:
            if i < j:
                p, q = b[i], b[j]
                sep = {a: abs(p[f"mid_{a}"] - q[f"mid_{a}"]) for a in "xyz"}
                mean = {a: (p[f"ext_{a}"] + q[f"ext_{a}"]) * 0.5 for a in "xyz"}
                over = {a: max(p[f"min_{a}"], q[f"min_{a}"]) <= min(p[f"max_{a}"], q[f"max_{a}"]) + 1e-3 for a in "xyz"}
                for k, a in enumerate("xyz"):
                    c, d = "xyz"[(k + 1) % 3], "xyz"[(k + 2) % 3]
                    near = sep[a] <= mean[a] * 1.6 + 1e-3 or (mean[a] < 0.05 and sep[a] <= max(mean[c], mean[d], 1.0) * 0.5)
                    if near and sep[a] > 1e-6 and over[c] and over[d]:
                        want.add((i, j, a))
                        break
    got = [(r.a, r.b, r.axis) for r in gap.adjacent(boxes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
