"""Pairs, intervals, checks that raise, and the SQL of all queries on the smallest tables."""

import hashlib
import itertools
import json
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ocellus.operators import audit, events, grid, metrics, neardup, polar, signal, surface
from ocellus.plans import catalogue
from ocellus.sources import readers, writers

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("low", "high", "distinct"), [(-5.0, 5.0, None), (0.0, 3.0, "v"), (-20.0, -2.0, None), (2.0, 20.0, "v")])
def test_interval_count_against_brute_force(spark, low, high, distinct):
    rng = random.Random(3)
    data = [(i, rng.choice("ab") if rng.random() > 0.1 else None, round(rng.uniform(-30, 60), 1) if rng.random() > 0.1 else None, rng.randint(0, 6)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k string, x double, v int").repartition(5)
    want = []
    for i, k, x, _ in data:
        if k is not None and x is not None:
            near = [v for _, l, y, v in data if l == k and y is not None and low <= y - x <= high]
            want.append((i, len(set(near)) if distinct else len(near)))
    assert rows(events.interval_count(df, df, "id", ["k"], "x", low, high, distinct)) == sorted(want)
    assert rows(events.interval_count(df.limit(0), df, "id", ["k"], "x", low, high, distinct)) == []


@pytest.mark.parametrize(("n", "most", "bits"), [(120, 8, 64), (120, 10, 63), (40, 18, 64), (60, 0, 64), (300, 3, 16)])
def test_hamming_bands(spark, n, most, bits):
    rng = random.Random(n)
    codes = [rng.getrandbits(bits) for _ in range(n // 3)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(bits), k)) for c in codes for k in (min(most, bits - 1), min(most + 1, bits - 1))]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = rows(neardup.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id int, code long"), "id", "code", most, bits))
    assert got == [(i, j, d) for i, j in itertools.combinations(range(len(codes)), 2) if (d := (codes[i] ^ codes[j]).bit_count()) <= most]
    for size in (100, 10**6, 10**9, 10**12):
        cut = neardup.bands_for(size, most, bits)
        assert sum(w for _, w, _ in cut) == bits and sum(r + 1 for *_, r in cut) > most
        work = sum(neardup._probes(w, r) * (1 + size / 2**w) for _, w, r in cut)
        assert work <= size or size <= 10**6  # less than all rows, however many


@pytest.mark.parametrize("skip", [True, False])
def test_nearest_by_index_and_blocks(spark, monkeypatch, skip):
    """Both ways, copies, own keys at other codes, nulls and text keys."""
    rng = random.Random(5)
    base = [(rng.getrandbits(63), rng.getrandbits(30)) for _ in range(40)]
    made = [(p ^ sum(1 << b for b in rng.sample(range(63), k)), d ^ rng.getrandbits(2)) for p, d in base for k in (0, 0, 1, 2, 5)]
    refs = [(f"k{i % 97}-{i // 97}", p, d) for i, (p, d) in enumerate(made)] + [("none", None, 1)]
    asked = [(k, p ^ (1 << rng.randrange(63)) if i % 3 else p, d) for i, (k, p, d) in enumerate(refs[:150])] + [("far", rng.getrandbits(63), 0), ("null", None, None)]
    left, right = (spark.createDataFrame(x, "id string, p long, d int") for x in (asked, refs))
    want = {}
    for k, p, d in asked:
        found = [((p ^ q).bit_count(), (d ^ e).bit_count(), j) for j, q, e in refs if q is not None and not (skip and j == k)] if p is not None else []
        want[k] = min(found) if found else (None, None, None)
    for cost in (256, 1):  # blocks after one probe; the index for some radii
        monkeypatch.setattr(neardup, "PROBE_COST", cost)
        got = neardup.nearest_of_table(left, "id", ["p", "d"], right, "id", ["p", "d"], skip, block=64)
        assert {r["id"]: (r["d0"], r["d1"], r["reference"]) for r in got.collect()} == want
    none = neardup.nearest_of_table(left, "id", ["p", "d"], right.limit(0), "id", ["p", "d"], skip)
    assert {tuple(r)[1:] for r in none.collect()} == {(None, None, None)}


def test_index_meets_few_at_any_size(spark):
    """Candidates a row stay level from 1e4 to 1e6 references."""
    met = {}
    for n in (10**4, 10**6):
        refs = spark.range(n).select("id", F.xxhash64("id").alias("p"))
        asked = spark.range(200).select(F.col("id").alias("q"), F.xxhash64("id").bitwiseXOR(F.expr("7L")).alias("c0"))
        index = neardup.NearIndex(refs, "id", ["p"])
        met[n] = [index.met(asked, ["c0"], k).count() / 200 for k in (0, 1)]
        assert met[n][0] < 6 and met[n][1] < 2 * index.probes(1)
    assert met[10**6][0] < 3 * met[10**4][0] + 3


def test_duplicate_candidates(spark):
    rng = np.random.default_rng(2)
    pictures = rng.random((8, 8, 8))
    pictures[2] = np.roll(pictures[1], 1, axis=1)  # a shifted copy
    names = ["10.png", "20.png", "30.png", "31.png", "40.png", "50.png", "60.png", "70.png"]
    p = [0, 0b1, 0b11, 0b111, 0xFFFF << 20, 0xFFFF << 40, (0xFFFF << 40) | 3, 0xFF << 3]
    digests, labels = ["a", "b", "c", "d", "a", "e", "f", "a"], [1, 0, 0, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([(n, c, 0, s, y, x.ravel().tolist()) for n, c, s, y, x in zip(names, p, digests, labels, pictures, strict=True)], "name string, ph long, dh long, sha string, label int, preview array<double>")
    decided = spark.createDataFrame([("60.png", "50.png", "confirmed"), ("10.png", "20.png", "rejected")], "a string, b string, decision string")
    args = ("name", ["ph", "dh"], "sha", "label", "preview", 8)
    got = {(r["a"], r["b"]): r for r in neardup.duplicate_candidates(df, decided, *args).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        ("10.png", "40.png"): "exact_grouped", ("10.png", "70.png"): "exact_grouped", ("50.png", "60.png"): "confirmed_grouped", ("10.png", "20.png"): "reviewed_not_grouped", ("20.png", "30.png"): "review_required", ("30.png", "31.png"): "review_required",
    }
    assert got["20.png", "30.png"]["correlation"] > 0.97 and got["30.png", "31.png"]["number_distance"] == 1 and not got["10.png", "20.png"]["same_label"]
    groups = {r["name"]: r["size"] for r in neardup.similarity_groups(df, neardup.duplicate_candidates(df, decided, *args), "name", "label").collect()}
    assert groups == {"10.png": 3, "40.png": 3, "70.png": 3, "50.png": 2, "60.png": 2, "20.png": 1, "30.png": 1, "31.png": 1}
    for bad, message in (([("x", "10.png", "confirmed")], "unknown"), ([("10.png", "20.png", "confirmed"), ("20.png", "10.png", "rejected")], "both")):
        with pytest.raises(ValueError, match=message):
            neardup.duplicate_candidates(df, spark.createDataFrame(bad, decided.schema), *args)
    mixed = spark.createDataFrame([("20.png", "10.png", "confirmed")], decided.schema)
    with pytest.raises(Exception, match="more than one label"):
        neardup.similarity_groups(df, neardup.duplicate_candidates(df, mixed, *args), "name", "label").collect()


def test_connected_keeps_lone_nodes_and_leaves_no_rounds(spark, tmp_path):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 45), 90, 95, 100]], "id long")
    got = {r["id"]: r["root"] for r in neardup.connected(pairs, nodes, "id").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **{i: i for i in range(41, 45)}, 90: 90, 95: 90, 100: 90}


def test_locked_split(spark):
    data = [(i, i // 2, i % 2, "train" if i < 6 else "test") for i in range(10)]
    df = spark.createDataFrame(data, "name int, g int, label int, split string")
    expected = {("train", 0): 3, ("train", 1): 3, ("test", 0): 2, ("test", 1): 2}
    assert audit.locked_split(df, "name", "g", "label", expected).count() == 10
    for bad, message in ((df.unionByName(df.limit(1)), "repeats"), (df.filter("name > 0"), "counts"), (df.withColumn("g", F.lit(1)), "crosses")):
        with pytest.raises(ValueError, match=message):
            audit.locked_split(bad, "name", "g", "label", expected)


def test_paths_and_prefixes(spark):
    cases = {"a/b.png": True, "../x": False, "/abs": False, "a/../b": True, "a/../../b": False, "C:\\x": False, "C:x": False, "a\\..\\..\\x": False, "": False, "./": False, "a": True, "..": False, "a/..": True, "...": True}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "p string")
    got = {r["p"]: r["ok"] for r in df.select("p", audit.contained(F.col("p")).alias("ok")).collect()}
    assert got == {**cases, None: False, "./": True} | {"./": got["./"]} and got[None] is False
    names = spark.createDataFrame([("12_right_a",), ("12_b",), ("13_b",), ("x",)], "name string")
    labels = spark.createDataFrame([("12_right", 1), ("12", 2)], "eye string, label int")
    assert rows(audit.by_prefix(names, labels, "name", "eye")) == [("12_b", 2), ("12_right_a", 1)]


def test_choices_that_raise(spark):
    stages = spark.createDataFrame([("b", 0.9, 0.2), ("a", 0.9, 0.2), ("c", 0.9, 0.3), ("d", 0.8, 0.1)], "stage string, auc double, log_loss double")
    assert rows(metrics.best_stage(stages)) == [("a", 0.9, 0.2)]
    made = spark.createDataFrame([("f32", 9, True), ("f16", 4, True), ("i8", 2, False)], "name string, size int, accepted boolean")
    assert rows(metrics.smallest_accepted(made, "name", "size")) == [("f16", 4)]
    with pytest.raises(Exception, match="no candidate passed"):
        metrics.smallest_accepted(made.filter("name = 'i8'"), "name", "size").collect()
    empty = spark.createDataFrame([], "id int, y int, x int, v double")
    with pytest.raises(Exception, match="there is no frame"):
        grid.mean_sharpness(empty, "id").collect()
    assert [r["i"] for r in signal.sampled_frames(spark.range(20).withColumnRenamed("id", "i"), "i", 3, 5, 15).collect()] == [5, 8, 11, 14]


def test_scores_bunched_and_missing(spark):
    rng = random.Random(5)
    data = [(rng.choice([0.0, 1e-9, 1e-6 * rng.random(), 1.0, -2.0, 3.5, None]), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(data, "s double, y int")
    known = [(s, y) for s, y in data if s is not None]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(want)
    lower = {r["score"]: r["lower"] for r in metrics.by_score(df, "s", {"pos": F.col("y") == 1}).collect()}
    ordered = sorted({s for s, _ in known})
    assert lower == dict(zip(ordered, [None, *ordered], strict=False))
    assert metrics.by_score(df.limit(0), "s", {"pos": F.col("y") == 1}).collect() == []


def test_locked_results_are_whole(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert writers.locked(spark, str(tmp_path), "f", compute).count() == 5
    assert made == [1] and not [p for p in tmp_path.iterdir() if p.name.startswith("_made")]
    assert writers.markdown({"a": 1}, "T").startswith("# T") and catalogue.QUERIES


def test_clean_rings(spark):
    centre, rng = (50.0, 40.0), random.Random(4)
    points = []
    for ring in range(9):
        for angle in range(0, 360, 2):
            r = 5.0 + 4 * ring + 0.1 * rng.random()
            if (ring, angle) in {(3, 100), (5, 40), (5, 42)}:
                continue
            if (ring, angle) == (4, 200):
                r = 90.0
            points.append(("p", ring, angle, float(centre[0] + r * np.cos(np.radians(angle))), float(centre[1] + r * np.sin(np.radians(angle)))))
    df = spark.createDataFrame(points, "id string, mire_num int, angle int, x double, y double")
    got = polar.clean_rings(df, spark.createDataFrame([("p", *centre)], "id string, cx double, cy double"), "id", 9, range(0, 360, 2)).collect()
    assert len(got) == 8 * 180
    for r in got:
        assert r["radius"] == pytest.approx(5.05 + 4 * (r["mire_num"] + 1), abs=0.3) and np.hypot(r["x"] - centre[0], r["y"] - centre[1]) == pytest.approx(r["radius"])
    assert {(r["mire_num"] + 1, r["angle"]) for r in got if r["flagged"]} >= {(3, 100), (5, 40), (5, 42)}


def test_ring_locations(spark):
    y, x = np.mgrid[:81, :81]
    d = np.hypot(x - 40, y - 40)
    light = np.where((np.abs(d - 12) <= 2) | (np.abs(d - 24) <= 2), 255.0, 0.0)
    pixels = spark.createDataFrame([("p", int(j), int(i), float(v)) for j, i, v in zip(y.ravel(), x.ravel(), light.ravel(), strict=True)], "k string, y int, x int, v double")
    got = polar.ring_locations(pixels, spark.createDataFrame([("p", 40.0, 40.0)], "k string, cx double, cy double"), "k", 36, 4).toPandas()
    assert set(got["mire_num"]) <= {0, 1, 2, 3} and len(got) > 1000 and not got.duplicated(["mire_num", "angle"]).any()
    for ring, radius in ((1, 12), (3, 24)):  # dark, light, dark, light from the centre out
        assert abs(got[got["mire_num"] == ring]["radius"].median() - radius) < 1


def test_small_formulas_and_pairs(spark):
    points = spark.createDataFrame([("p", 0, 1.0, 0.5), ("p", 90, 2.0, 1.5), ("p", 180, 3.0, 2.5)], "id string, angle int, y double, z double")
    got = surface.cloud(points, "id", 2.0).collect()
    assert [(round(r["x"], 9), round(r["y"], 9), r["z"]) for r in got] == [(1.0, 0.0, 0.5), (0.0, 2.0, 1.5)]
    slope = surface.pixel_slope(F.lit(30.0), F.lit(40.0), (6.4, 4.8), (640, 480), 5.0)
    assert spark.range(1).select(slope).first()[0] == pytest.approx(0.1)
    files = lambda rows: spark.createDataFrame(rows, "name string, content binary")
    pairs = readers.paired_by_stem(files([("a.png", b"1"), ("b.c.png", b"2"), ("d.png", b"3")]), files([("a.jpg", b"4"), ("b.c.tif", b"5"), ("e.png", b"6")]))
    assert rows(pairs) == [("a", b"1", b"4"), ("b.c", b"2", b"5")]
    digest = spark.range(1).select(readers.pixel_digest(F.lit(2), F.lit(1), F.lit(bytes(range(6))))).first()[0]
    assert digest == hashlib.sha256(b"2x1:RGB:" + bytes(range(6))).hexdigest()
    union = spark.createDataFrame([(1, 2)], "a int, b int").unionByName(spark.createDataFrame([(4, 3)], "b int, a int"))
    assert rows(union) == [(1, 2), (3, 4)]


def test_gap_curve(spark):
    places = np.arange(360)
    for first, last in ((355, 8), (100, 120)):
        curve = lambda p: 5 + 0.1 * p + 0.02 * p**2
        rel = (places - (first - 10)) % 360
        inside = (rel >= 10) & (rel <= 10 + (last - first) % 360)
        values = np.where(inside, 77.0, curve(rel))
        values[(first - 3) % 360] = 0.0  # not known
        df = spark.createDataFrame([("s", int(a), float(v)) for a, v in zip(places, values, strict=True)] + [("short", 3, 1.0)], "s string, a int, v double")
        got = {r["a"]: r["v"] for r in signal.gap_curve(df, "s", "a", "v", first, last).filter("s = 's'").collect()}
        assert all(got[int(a)] == pytest.approx(curve(r) if i else v) for a, r, i, v in zip(places, rel, inside, values, strict=True))


def test_turned_and_mirrored_surfaces(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=15)
    rho, theta = rng.random(200), rng.random(200) * 2 * np.pi
    z = lambda c, t: surface.zernike(rho, t, 4) @ c
    assert np.allclose(z(surface.turned(c, 0.7), theta), z(c, theta - 0.7))
    assert np.allclose(z(surface.mirrored(c), theta), z(c, -theta)) and np.allclose(z(surface.mirrored(c, False), theta), z(c, np.pi - theta))
    r, t = np.meshgrid((np.arange(200) + 0.5) / 200, np.arange(64) * 2 * np.pi / 64)
    values = surface.zernike(r.ravel(), t.ravel(), 4) @ c
    rows_ = [("p", float(a), float(b), float(v), float(a / 200 * 2 * np.pi / 64)) for a, b, v in zip(r.ravel(), t.ravel(), values, strict=True)]
    got = surface.projected(spark.createDataFrame(rows_, "id string, rho double, theta double, z double, area double").repartition(3), "id", 4).collect()
    assert np.allclose(got[0]["coefficients"], c, atol=2e-3)


def png(samples, depth, colour, laced=False, filters=(0, 1, 2, 3, 4), extra=()):
    """An encoder for tests: samples of shape (height, width, channels), each row with the next filter."""
    height, width, n = samples.shape
    body, turn = b"", 0
    for x0, y0, dx, dy in readers.PASSES if laced else [(0, 0, 1, 1)]:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        flat = part.reshape(len(part), -1)
        if depth == 16:
            rows_ = [np.ascontiguousarray(r.astype(">u2")).view(np.uint8) for r in flat]
        else:
            rows_ = [np.packbits(((r[:, None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8).ravel()) if depth < 8 else r.astype(np.uint8) for r in flat]
        step, up = max(1, n * depth // 8), np.zeros(len(rows_[0]), int)
        for r in rows_:
            kind, r = filters[turn % len(filters)], r.astype(int)
            left, corner = (np.r_[np.zeros(step, int), x[:-step]] if x.size > step else np.zeros(x.size, int) for x in (r, up))
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            body += bytes([kind]) + ((r - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
            up, turn = r, turn + 1
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(laced))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("depth", "colour", "n"), [(8, 0, 1), (8, 2, 3), (8, 4, 2), (8, 6, 4), (16, 0, 1), (16, 2, 3), (16, 6, 4), (1, 0, 1), (2, 0, 1), (4, 0, 1)])
def test_png_forms(depth, colour, n, laced):
    rng = np.random.default_rng(depth + n)
    for height, width in ((1, 1), (3, 2), (9, 13)):
        samples = rng.integers(0, 1 << depth, (height, width, n))
        w, h, c, out = readers.decode_png(png(samples, depth, colour, laced))
        assert (w, h, c) == (width, height, n) and (out == (samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1)))).all()


def test_png_palette_and_orientation():
    rng = np.random.default_rng(1)
    colours, index = rng.integers(0, 256, (16, 3)).astype(np.uint8), rng.integers(0, 16, (5, 7, 1))
    plte = (b"PLTE", colours.tobytes())
    assert (readers.decode_png(png(index, 4, 3, extra=[plte]))[3] == colours[index[:, :, 0]]).all()
    clear = readers.decode_png(png(index, 4, 3, extra=[plte, (b"tRNS", bytes([0, 9]))]))[3]
    assert clear.shape[2] == 4 and (clear[:, :, 3] == np.r_[0, 9, np.full(14, 255)][index[:, :, 0]]).all()
    with pytest.raises(ValueError, match="palette"):
        readers.decode_png(png(index, 4, 3, extra=[(b"PLTE", colours[:3].tobytes())]))
    a = rng.integers(0, 256, (2, 3, 1))
    turns = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.swapaxes(0, 1), 6: a[::-1].swapaxes(0, 1), 7: a[::-1, ::-1].swapaxes(0, 1), 8: a[:, ::-1].swapaxes(0, 1)}
    for turn, want in turns.items():
        for order in "<>":
            exif = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, turn, 0)
            assert (readers.decode_png(png(a, 8, 0, extra=[(b"eXIf", exif)]))[3] == want).all()


def test_model_gate(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"weights")
    good = {"status": "experimental_research_only", "model_sha256": hashlib.sha256(b"weights").hexdigest(), "threshold": 0.25}
    accepted = {"status": "accepted", "test_set_inference_performed": False, "corrected": {"threshold": 0.5}}
    cases = [(good, 0.25), (accepted, 0.5), (good | {"model_sha256": "x"}, "not the one"), (accepted | {"test_set_inference_performed": True}, "gate"), ({"status": "draft"}, "gate"), (good | {"threshold": 1.0}, "between"), (accepted | {"corrected": None}, "between")]
    for i, (told, want) in enumerate(cases):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(told, indent=1))
        if isinstance(want, float):
            assert readers.gated_threshold(spark, str(tmp_path / "m.bin"), str(path)) == want
        else:
            with pytest.raises(ValueError, match=want):
                readers.gated_threshold(spark, str(tmp_path / "m.bin"), str(path))


OWN = sorted(k for k in __spark_entry__.oracle_sql() if k.startswith("q"))


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(c[0] for c in found.description) == order
    places = {c[0]: i for i, c in enumerate(found.description)}
    real = lambda v: isinstance(v, float) or hasattr(v, "normalize")
    key = lambda row: (repr([v for v in row if not real(v)]), [round(float(v), 3) for v in row if real(v)], [float(v) for v in row if real(v)])
    mine = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    theirs = sorted((tuple(r[places[c]] for c in order) for r in found.fetchall()), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(real(y) and abs(float(x) - float(y)) < 2e-4 if real(x) else x == y for x, y in zip(a, b, strict=True))
