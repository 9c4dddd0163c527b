"""Exact answers on small fixtures, invariances, and each query against its SQL."""

import glob
import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.config import SMALL_FRAMES, ScoreRule, apply_knobs
from prismark.functions import pixels, robust, shapes
from prismark.operators import filters, quality, reduce, select
from prismark.plans import registry


def circle(n=200, r=60, dx=0):
    y, x = np.mgrid[:n, :n]
    return (x - n // 2 - dx) ** 2 + (y - n // 2) ** 2 <= r * r


def one(stack):
    return pixels.frame_stats(stack[None], np.zeros((1, *stack.shape)), np.zeros((1, *stack.shape)), 9, 3, 2)


def test_seeds_and_candidates():
    assert select.quality_seeds(np.array([0.1, 0.9, 0.3, 0.7, 0.2]), 3) == [1, 3, 2]
    x = np.eye(5, 8)
    q = np.array([0.3, 0.1, 0.9, 0.2, 0.7])
    assert select.farthest_points(x, 3, int(q.argmax())) == [2, 0, 1]
    assert select.farthest_points(x, 2, 0) == [0, 1]
    assert select.neighbourhood(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 0, 1, 0, 1]), 0, 2) == [0, 1]
    assert select.neighbourhood(np.array([0.5, 0.6, 0.1, 0.2]), np.array([0, 0, 1, 1]), 0, 0) == [0]


def test_greedy_starts_at_best_and_follows_the_formula():
    q, x = np.array([0.2, 0.8, 0.5, 0.9]), np.eye(4)
    picks = select.greedy_quality_diversity(x, q, 4, 0.4, 0.6)
    assert picks == [3, 1, 2, 0]
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(30, 16)), rng.random(30)
    for mode, fold in (("min", np.min), ("max", np.max)):
        picks = select.greedy_quality_diversity(x, q, 8, 0.4, 0.6, mode)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        for k in range(1, 8):
            score = 0.4 * q + 0.6 * fold(1 - unit @ unit[picks[:k]].T, axis=1)
            score[picks[:k]] = -np.inf
            assert score.argmax() == picks[k]
    with pytest.raises(ValueError):
        select.greedy_quality_diversity(x, q, 3, 1, 1, "other")


def test_determinantal_is_greedy_log_determinant():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(20, 6)), rng.random(20) + 0.1
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    kernel = np.outer(q, q) * np.exp(-(1 - unit @ unit.T) / 0.5)
    picks = select.determinantal(x, q, 5, 0.5)
    for k in range(5):
        gains = [-np.inf if i in picks[:k] else np.linalg.slogdet(kernel[np.ix_(picks[:k] + [i], picks[:k] + [i])])[1] for i in range(20)]
        assert int(np.argmax(gains)) == picks[k]
    assert sorted(select.determinantal(np.array([[1.0, 0], [1, 0], [0, 1]]), np.ones(3), 3, 0.5)) == [0, 1, 2]


def test_kmeans_neighbourhoods():
    angles = np.deg2rad([0, 2, 120, 122, 240, 242])
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    assert set(select.kmeans_neighbourhoods(x, np.array([1, 0.5, 1, 0.5, 1, 0.5]), 3, xnn=3)) == {0, 2, 4}
    labels = np.array([0, 0, 0, 1, 1, 1])
    picks = select.fill_up(np.random.default_rng(0).normal(size=(6, 4)), np.array([1, 0.9, 0.8, 0.3, 0.2, 0.1]), labels, [0], 6, [0, 1])
    assert set(picks[1:3]) == {1, 2} and set(picks[3:]) == {3, 4, 5}
    for n in (0, 1, 6, 9):
        got = select.kmeans_neighbourhoods(x, np.ones(6), min(n, 6))
        assert len(got) == len(set(got)) == min(n, 6)


def test_robust(spark):
    got = robust.robust_fit(spark.createDataFrame([(0, v) for v in (1.0, 2.0, 3.0, 100.0)], "g int, v double"), "v", ["g"]).first()
    assert got.center == 2.5 and got.scale > 0
    with pytest.raises(ValueError):
        robust.tail_rejected(F.lit(1.0), 2.0, "up")


def test_edges_and_border():
    m = np.zeros((100, 100))
    m[0:75, 0:50] = 1
    assert one(m)["border_ratio"][0] == pytest.approx(124 / 3750)
    m = np.zeros((100, 100))
    m[0, 0] = 1
    assert one(m)["border_ratio"][0] == 1.0
    m = np.zeros((100, 100))
    m[:30, 20:80] = 1
    assert one(m)["edge_top_ratio"][0] == 1.0 and one(m)["edge_bottom_ratio"][0] == 0.0
    assert one(circle(200, 60).astype(int))["artifact_fraction"][0] < 0.01
    assert one(np.zeros((50, 50)))["edge_ratio"][0] == 0.0


def test_kernels():
    assert sorted(pixels.ellipse(3)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    flat = np.full((1, 9, 9), 7.0)
    assert (pixels.convolve3(flat, pixels.LAPLACE_8) == 0).all() and (pixels.gradient(flat) == 0).all()
    on = circle(40, 10)[None]
    assert pixels.grow(on, 2).sum() > on.sum() and (pixels.grow(on, 0) == on).all()
    image = np.full((40, 40, 3), 200, np.uint8)
    assert pixels.contrast_input(image, on[0], 0, by=2, size=32).shape == (32, 32, 3)
    assert {168, 204, 255} <= set(np.unique(pixels.region_alpha(on[0], 2))) and pixels.region_alpha(on[0], 2).min() == 168
    assert pixels.contrast_input(image, np.zeros((40, 40)), 255, size=16).min() == 255
    square = np.arange(64 * 64, dtype=float).reshape(64, 64) % 251
    assert pixels.thumbnail_distance(square, square) == 0.0


def test_shape_invariances():
    y, x = np.mgrid[:160, :160]
    ell = ((x - 70) / 40) ** 2 + ((y - 80) / 20) ** 2 <= 1
    moved = np.roll(ell, (7, 9), axis=(0, 1))
    turned = np.rot90(ell)
    for name, close in (("hu", 1e-6), ("fourier", 0.02), ("silhouette", 1e-9), ("shape_context", 1e-9)):
        a = shapes.describe(ell, name)
        assert np.allclose(a, shapes.describe(moved, name), atol=close), name
    assert np.allclose(shapes.hu_moments(ell)[:2], shapes.hu_moments(turned)[:2], atol=1e-6)
    assert [len(shapes.describe(ell, n)) for n in ("hu", "zernike", "fourier", "shape_context", "silhouette")] == [7, 65, 32, 60, 4096]
    assert all(np.isfinite(shapes.describe(np.zeros((20, 20)), n)).all() for n in shapes.DESCRIPTORS)
    s = shapes.completeness(circle(200, 60))
    assert s[0] > 0.97 and shapes.completeness(np.zeros((10, 10))) is None
    with pytest.raises(ValueError):
        shapes.describe(ell, "other")


def test_outlier_wrapper_and_floor(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, float(v)) for i, v in enumerate([*rng.normal(0.5, 0.1, 49), -1.0])]
    df = spark.createDataFrame(rows, "object_id int, pos int, score double")
    got = filters.outlier_on_score(df, F.lit(True), F.lit("x"), "score", 3.0).collect()
    bad = {r.pos: r.rejection_reason for r in got}
    assert bad[49] == "x_outlier" and bad[0] is None
    q = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(rng.uniform(0.4, 1, 100))], "object_id int, pos int, quality double")
    from prismark.config import Floor

    floor = quality.floors(q, Floor(0.10, 20, 0.0), 10)
    assert 85 <= quality.selection_pool(q, floor).count() <= 91
    assert quality.selection_pool(q, quality.floors(q, Floor(0.10, 200, 0.9), 99)).count() >= 99


def test_rule_off_and_knobs(spark):
    df = spark.createDataFrame([(0, 1.0)], "object_id int, laplacian double")
    off = ScoreRule("r", "laplacian", hard_min=5.0, enabled=False)
    assert tuple(filters.verdict(df, off).select("score", "passed", "reason").first()) == (1.0, True, "")
    cfg = apply_knobs(SMALL_FRAMES, {"blur_laplacian": {"hard_min": 1.0, "z": None, "nothing": 3}, "unknown": {"z": 1}})
    assert cfg.rules[0].hard_min == 1.0 and cfg.rules[0].z is None and cfg.rules[1] == SMALL_FRAMES.rules[1]


def test_strategies_agree(spark, sf):
    from prismark.plans.frames import pool

    p = pool(spark, sf)
    for mode in ("min", "max", "prototype"):
        a, b = (sorted(map(tuple, select.select_gqd(p, 4, 0.6, 0.4, mode, s).collect())) for s in ("grouped", "rounds"))
        assert a == b
    for f in (select.select_fps, select.select_nbv):
        assert sorted(map(tuple, f(p, 4, strategy="grouped").collect())) == sorted(map(tuple, f(p, 4, strategy="rounds").collect()))


def test_reductions():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (12, 6)), rng.normal(3, 0.1, (12, 6))])
    for f in reduce.METHODS.values():
        out = f(x, 2)
        assert out.shape == (24, 2) and np.isfinite(out).all()
    assert reduce.discriminant(x, np.repeat([0, 1], 12), 2).shape == (24, 1)


def test_stream_judges_like_batch(spark, sf, tmp_path):
    from prismark.plans.frames import frames, with_stats
    from prismark.streaming.ingest import judge

    stats = with_stats(frames(spark, sf), SMALL_FRAMES.kernels)
    stats.write.parquet(str(tmp_path / "in"))
    stream = judge(spark.readStream.schema(stats.schema).parquet(str(tmp_path / "in")), SMALL_FRAMES)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = judge(stats, SMALL_FRAMES)
    key = lambda df: sorted(map(tuple, df.select("pos", "rejection_reason").collect()), key=str)
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def png(path, image):
    from prismark.functions.overlays import png as encode

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(encode(np.asarray(image)))


def test_overlays():
    from prismark.functions import overlays

    image, mask = np.full((20, 20, 3), 100, np.uint8), np.zeros((20, 20))
    mask[5:15, 5:15] = 1
    out = overlays.composite(image, mask)
    assert tuple(out[10, 10]) == (25, 216, 25) and tuple(out[0, 0]) == (66, 66, 66)
    assert tuple(overlays.blend(image, mask)[10, 10]) == (50, 177, 50)
    assert tuple(overlays.feature(image, mask, "edge_ratio")[0, 10]) == overlays.FRAME
    assert tuple(overlays.feature(image, mask, "laplacian")[0, 0]) == (50, 50, 50)
    assert [overlays.tick(v) for v in (None, 0, 0.5, 1e-5, 12.0)] == ["", "0", "0.5", "0.00001", "12"]


def test_scan_and_decode(spark, tmp_path):
    from prismark.sources import images

    color = np.zeros((4, 6, 3))
    color[..., 0] = 200  # red
    for obj, stems in (("cup", ("2", "10", "3")), ("pen", ("1",))):
        for s in stems:
            png(tmp_path / obj / "images" / f"{s}.png", color)
            if (obj, s) != ("cup", "3"):
                png(tmp_path / obj / "masks" / f"{s}.png", np.full((4, 6), 255))
    png(tmp_path / "cup" / "hand_masks" / "2.png", np.zeros((4, 6)))
    rows = {(r.object_id, r.id): (r.pos, r.hand_path is not None) for r in images.scan(spark, str(tmp_path)).collect()}
    assert rows == {("cup", 10): (0, False), ("cup", 2): (1, True), ("pen", 1): (0, False)}
    r = images.decode(spark, str(tmp_path / "pen" / "images")).first()
    assert (r.object_id, r.stem, r.height, r.width, r.channels) == ("pen", "1", 4, 6, 3) and tuple(r.data[:3]) == (0, 0, 200)
    assert images.exists(spark, str(tmp_path)) and not images.exists(spark, str(tmp_path / "none"))


def test_run_is_written_and_read(spark, sf, tmp_path):
    from prismark.operators import evaluate
    from prismark.sources import images

    scored, kept, picks = registry._picks(spark, sf)
    out = str(tmp_path / "run")
    images.write_run(out, scored.where("rejection_reason is null"), scored.where("rejection_reason is not null"), kept, picks, evaluate.run_report(scored, kept, picks))
    pool, again = images.load_snapshot(spark, out)
    assert pool.count() == kept.count() and sorted(map(tuple, again.collect())) == sorted(map(tuple, picks.collect()))
    assert spark.read.option("header", True).csv(f"{out}/rejected_metrics.csv").count() == scored.where("rejection_reason is not null").count()


def plain(rows, names):
    return sorted(repr([None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) else v for v in (r[names.index(c)] for c in sorted(names))]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_hu_moments_next_to_zero(spark, tmp_path):
    """Masks with a moment between 1e-14 and 3e-14, which is not zero, and one whose moments are."""
    duckdb = pytest.importorskip("duckdb")
    masks = [0x5C70567A2E4C00, 0x6E3A7C567E5000, 0x20362C4A780A5E00, 0x3C3C3C3C0000]
    rows = [(k, [0.5 if mask >> i & 1 else -0.5 for i in range(64)], 0) for k, mask in enumerate(masks, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    rel, got = con.sql(registry.ORACLE_SQL["hu_moments"]), registry.QUERIES["hu_moments"](spark, str(tmp_path))
    want = rel.fetchall()
    assert sum(23.0255 < abs(v) < 23.0258 for r in want for v in r[1:]) == 3
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want, rel.columns)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_mds_scales_every_object(spark, sf):
    got = registry.QUERIES["mds"](spark, sf).collect()
    want = registry.pool(spark, sf).select("object_id", "pos").collect()
    assert sorted((r.object_id, r.pos) for r in got) == sorted(map(tuple, want)) and len({r.object_id for r in got}) > 3
    assert all(len(r.coords) == 2 and np.isfinite(r.coords).all() for r in got)


def test_mds_in_tiles(monkeypatch):
    """Tiles, held or made anew, give what one matrix gives; a plane's distances come back."""
    x = np.random.default_rng(2).normal(size=(50, 2))
    want, cosine = reduce.mds_euclidean(x, 2), reduce.mds_cosine(x, 2)
    far = lambda y: np.linalg.norm(y[:, None] - y[None], axis=2)
    assert np.abs(far(want) - far(x)).mean() < 0.1 * far(x).mean()
    monkeypatch.setattr(reduce, "TILE", 16)
    for held in (1 << 25, 0):
        monkeypatch.setattr(reduce, "HELD", held)
        assert np.allclose(reduce.mds_euclidean(x, 2), want) and np.allclose(reduce.mds_cosine(x, 2), cosine)


def test_mds_start_by_start(spark, monkeypatch):
    """Starts in tasks of their own give what one task gives, also with equal positions; single pairs in single precision change little."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 6))
    rows = [(0, k // 2, v.tolist()) for k, v in enumerate(x)] + [(1, 5, [1.0] * 6), (None, 1, [1.0] * 6), (None, 2, [2.0] * 5 + [0.0])]
    plan = reduce.by_object(spark.createDataFrame(rows, "object_id int, pos long, embedding array<double>").coalesce(1), "mds_cosine")
    got = plan.collect()
    assert sorted((str(r.object_id), r.pos) for r in got) == sorted((str(o), p) for o, p, _ in rows)
    want = reduce.mds_cosine(x, 2)
    mine = np.array(sorted(r.coords for r in got if r.object_id == 0))
    assert np.allclose(mine, np.array(sorted(want.tolist())), atol=1e-9)
    assert [r.coords for r in got if r.object_id == 1] == [[0.0, 0.0]]
    assert "start" in plan._jdf.queryExecution().optimizedPlan().toString()
    far = reduce.cosine(x)(slice(0, 70), slice(0, 70))
    stress = lambda y: np.square(np.linalg.norm(y[:, None] - y[None], axis=2) - far).sum() / 2
    monkeypatch.setattr(reduce, "WHOLE", 10)
    assert stress(reduce.mds_cosine(x, 2)) == pytest.approx(stress(want), rel=1e-3)
    monkeypatch.undo()
    y, said = reduce.smacof_start(reduce.cosine(x), 70, 2, rounds=40)
    assert said == pytest.approx(stress(y), rel=0.02) and said >= stress(y) - 1e-9


# --- populations -----------------------------------------------------------------------------------------------------


def test_quantiles_both_ways(spark):
    """Held whole or narrowed down by histograms: the same numbers, with ties, nulls, negative, tiny and huge values, and null groups."""
    from prismark.functions.quantiles import quantiles

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=301), "b": np.repeat([1.0, 2.0, 2.0, 5.0], 50), "c": 10.0 ** rng.uniform(-200, 200, 120) * rng.choice([-1, 1], 120), "d": np.array([3.0]), None: rng.integers(0, 4, 60).astype(float)}
    rows = [(g, float(v), float(-v)) for g, vs in groups.items() for v in vs] + [("a", None, 1.0), ("e", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    wanted = [("lo", "x", 0.01), ("mid", "x", 0.5), ("hi", "y", 0.95)]
    plain_, narrowed = ({r.g: (r.lo, r.mid, r.hi) for r in quantiles(df, ["g"], wanted, most=m).collect()} for m in (1 << 17, 7))
    assert narrowed == {g: v for g, v in plain_.items() if g != "e"} | ({"e": plain_["e"]} if "e" in narrowed else {})
    for g, vs in groups.items():
        assert narrowed[g][1] == pytest.approx(np.percentile(vs, 50), rel=1e-12)
    assert quantiles(df.limit(0), ["g"], wanted).count() == 0


def test_frames_are_read_once(spark, sf, monkeypatch):
    """Chain, soft pass, scores and picks read the stored statistics: one Arrow pass over frames, and one aggregation pair for all fits."""
    labels = []
    keep = registry.written
    monkeypatch.setattr(registry, "written", lambda df, label: labels.append((label, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))) or keep(df, label))
    for name in ("filter_chain", "soft_pass", "curate", "quality_report_rows"):
        labels.clear()
        got = registry.QUERIES[name](spark, sf)
        got.collect()
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString(), name
        assert [n for label, n in labels if n] == [1] and sum(label == "stats" for label, _ in labels) == 1, (name, labels)


def test_chain_in_any_order(spark, sf):
    from prismark.config import KNOB_TABLE, active_knobs, set_knobs

    st = registry._stored(spark, sf)
    with pytest.warns(UserWarning, match="no_such"):
        first = filters.chain(st, SMALL_FRAMES, ("no_such", "blur_tenengrad", "vincent_empty_mask"))
    second = filters.chain(st, SMALL_FRAMES, ("vincent_empty_mask", "blur_tenengrad"))
    reasons = lambda df: {r.pos: r.rejection_reason for r in df.collect()}
    a, b = reasons(first), reasons(second)
    assert {k for k in a if a[k]} == {k for k in b if b[k]} and a != b
    assert not any(reasons(filters.chain(st, SMALL_FRAMES, ())).values())
    assert len(KNOB_TABLE) == 16 and [k[0] for k in active_knobs(("vincents_area",))] == ["vincents_area.hard_min_area_fraction", "vincents_area.outlier_z", "vincents_area.softness"]
    cfg = set_knobs(SMALL_FRAMES, params={"vincents_artefacts.kernel_size": 7.6}, cutoffs={"blur_laplacian.outlier_z": {"enabled": False, "value": 3}})
    assert cfg.kernels.artifact == 8 and cfg.rules[0].z is None
    with pytest.raises(ValueError):
        filters.what_if(st, SMALL_FRAMES, params={"vincents_artefacts.kernel_size": 9})


# --- descriptors, neighbours, reductions -----------------------------------------------------------------------------


def test_zernike_by_definition():
    from math import atan2, cos, factorial, hypot, pi, sin

    rng = np.random.default_rng(3)
    for shape in ((9, 9), (12, 7)):
        mask = rng.random(shape) > 0.5
        on = shapes._shorter_square(mask)
        side, axis, want = min(shape), np.linspace(-1, 1, min(shape)), []
        for n in range(5):
            for m in range(-n, n + 1, 2):
                total = 0.0
                for i in range(side):
                    for j in range(side):
                        r, t = hypot(axis[j], axis[i]), atan2(axis[i], axis[j])
                        if r <= 1:
                            k = abs(m)
                            radial = sum((-1) ** s * factorial(n - s) / (factorial(s) * factorial((n + k) // 2 - s) * factorial((n - k) // 2 - s)) * r ** (n - 2 * s) for s in range((n - k) // 2 + 1))
                            total += on[i, j] * radial * (cos(m * t) if m >= 0 else sin(k * t))
                want.append(abs(total * (n + 1) / pi))
        assert np.allclose(shapes.zernike(mask, 4), want[1:], atol=1e-9)
    square = rng.random((8, 8)) > 0.4
    assert np.array_equal(shapes._shorter_square(square), square)
    assert np.allclose(shapes.zernike_all(np.stack([square, ~square]))[1], shapes.zernike(~square))


def test_shape_context_by_definition():
    disc = circle(100, 30)
    hist = shapes.shape_context(disc).reshape(5, 12)
    assert hist[:4].sum() == 0 and hist[4].sum() == pytest.approx(1, abs=1e-6) and hist[4].max() < 0.13
    mask = np.zeros((20, 20))
    mask[3:9, 2:18] = 1
    c = shapes.contour(mask)
    c = c if len(c) <= 64 else c[np.linspace(0, len(c) - 1, 64, dtype=int)]
    mid, want = c.mean(axis=0), np.zeros((5, 12))
    top = max(np.hypot(*(p - mid)) for p in c)
    for p in c:
        far, turn = np.hypot(*(p - mid)), np.arctan2(p[1] - mid[1], p[0] - mid[0])
        ring = next(k for k in range(5) if far <= top * (k + 1) / 5 * 1.05 + 1e-12)
        wedge = next(k for k in range(12) if turn <= -np.pi + (k + 1) * np.pi / 6 + 1e-12)
        want[ring, wedge] += 1
    assert np.allclose(shapes.shape_context(mask).reshape(5, 12), want / want.sum(), atol=1e-6)
    assert not shapes.shape_context(np.zeros((9, 9))).any()


def test_neighbours_in_blocks(spark, sf):
    from prismark.operators import neighbors
    from prismark.plans.frames import pool

    p = pool(spark, sf).withColumn("cluster", F.col("pos") % 3)
    for first in (False, True):
        whole, parts = ({(r.i, r["rank"]): r.j for r in neighbors.knn(p, p, 4, first, block=b).collect()} for b in (1024, 7))
        assert whole == parts and len(whole) == 4 * p.count()
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (0, 3, [0.0, 0.0]), (1, 4, [0.0, 2.0])]
    few = spark.createDataFrame(rows, "object_id int, pos long, embedding array<double>")
    got = {(r.i, r["rank"]): (r.j, round(r.dist, 6)) for r in neighbors.knn(few, few, 5, block=1).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 1.0), (2, 1): (1, 0.0), (2, 2): (3, 1.0), (3, 1): (1, 1.0), (3, 2): (2, 1.0)}


def test_reductions_keep_structure():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (15, 6)), rng.normal(3, 0.1, (15, 6))])
    side = np.repeat([0, 1], 15)
    more = np.concatenate([rng.normal(0, 0.1, (60, 6)), rng.normal(3, 0.1, (60, 6))])  # t-SNE's 30 neighbours must be fewer than a cluster
    for f, z, parts in ((reduce.mds_euclidean, x, side), (reduce.tsne, more, np.repeat([0, 1], 60))):
        y = f(z, 2)
        near = np.linalg.norm(y[:, None] - y[None], axis=2)
        np.fill_diagonal(near, np.inf)
        assert (parts[near.argmin(axis=1)] == parts).all(), f.__name__
    line = np.linspace(0, 1, 40)[:, None] * np.array([[1.0, 2.0, 3.0]])
    for f in (reduce.isomap, reduce.locally_linear):
        y = f(line, 1)[:, 0]
        assert (np.diff(y) > 0).all() or (np.diff(y) < 0).all()
    labels = reduce.best_labels(x, 2)
    assert len(set(labels[:15])) == len(set(labels[15:])) == 1 and labels[0] != labels[-1]
    assert len(set(reduce.best_labels(x[:3], 9))) == 3 and len(set(reduce.best_labels(x, 1))) == 2 and list(reduce.best_labels(x[:1], 5)) == [0]
    d = reduce.discriminant(x, side, 2)
    assert d.shape == (30, 1) and (d[:15].max() < d[15:].min() or d[:15].min() > d[15:].max())
    assert [reduce.shown(*a) for a in ((1, 2, 2), (2, 2, 2), (3, 3, 3), (4, 3, 3), (9, 1, 2))] == [False, True, False, True, False]


def most_mb(f, *args):
    """What f returns and the MB of arrays it held at most."""
    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_isomap_in_blocks(monkeypatch):
    """Paths by blocks of sources, on disk, and the axes of a Krylov space, against Floyd and Warshall and all axes; a row is not its own neighbour."""
    rng = np.random.default_rng(6)
    parts = np.concatenate([rng.normal(size=(90, 5)), rng.normal(size=(70, 5)) + 50])
    copies = np.repeat(rng.normal(size=(9, 5)), 20, axis=0)  # more than neighbours
    for x in (rng.normal(size=(150, 5)), parts, copies):
        near, far = reduce.nearest(x, 15)
        true = np.linalg.norm(x[:, None] - x[None], axis=2)
        rows = np.arange(len(x))[:, None]
        assert (near != rows).all() and np.allclose(far, true[rows, near])
        np.fill_diagonal(true, np.inf)
        assert np.allclose(far, np.sort(true, axis=1)[:, :15])
        path = np.full_like(true, np.inf)
        np.fill_diagonal(path, 0)
        path[rows, near] = far
        path = np.minimum(path, path.T)
        for m in range(len(x)):
            path = np.minimum(path, path[:, m : m + 1] + path[m : m + 1])
        path[np.isinf(path)] = path[np.isfinite(path)].max()
        with monkeypatch.context() as m:
            m.setattr(reduce, "SOURCES", 32)
            assert np.allclose(reduce._squared_paths(near, far), path**2)
            want = reduce.isomap(x, 2)
            m.setattr(reduce, "WHOLE", 64)
            m.setattr(reduce, "BLOCK", 1 << 12)
            assert np.allclose(reduce._squared_paths(near, far), path**2, rtol=1e-5)
            if x is not copies:  # there the axes are no less alike than the rows
                assert np.allclose(reduce.isomap(x, 2), want, atol=1e-4 * np.abs(want).max())
    got, mb = most_mb(reduce.isomap, rng.normal(size=(2500, 64)), 2)
    assert np.isfinite(got).all() and mb < 200


def test_locally_linear_in_tiles(monkeypatch):
    """A factor in tiles on disk gives what all axes of the whole matrix give."""
    rng = np.random.default_rng(8)
    t = np.sort(rng.random(300)) * 9 + 3
    roll = np.column_stack([t * np.cos(t), rng.random(300) * 10, t * np.sin(t)])
    for x in (rng.normal(size=(300, 6)), roll):
        near, _ = reduce.nearest(x, 15)
        left = np.eye(300)
        for i, js in enumerate(near):
            z = x[js] - x[i]
            c = z @ z.T
            w = np.linalg.solve(c + np.eye(15) * 1e-3 * np.trace(c), np.ones(15))
            left[i, js] -= w / w.sum()
        m = left.T @ left
        row, column, value = reduce._embedding_matrix(near, reduce._weights(x, near, 1e-3))
        under = np.zeros((300, 300))
        under[row, column] = value
        assert np.allclose(under, np.tril(m))
        b = rng.normal(size=(300, 2))
        assert np.allclose(reduce.Solver(300, row, column, value, 0.1, side=64)(b), np.linalg.solve(m + 0.1 * np.eye(300), b))
        want = np.linalg.eigh(m)[1][:, 1:3]
        assert np.allclose(np.abs(reduce.locally_linear(x, 2)), np.abs(want), atol=1e-8)
        with monkeypatch.context() as p:
            p.setattr(reduce, "WHOLE", 64)
            p.setattr(reduce, "FACTOR", 64)
            p.setattr(reduce, "BLOCK", 1 << 12)
            assert np.allclose(np.abs(reduce.locally_linear(x, 2)), np.abs(want), atol=1e-6)
    copies = np.repeat(rng.normal(size=(9, 5)), 20, axis=0)  # more than neighbours: parts that nothing joins
    monkeypatch.setattr(reduce, "WHOLE", 64)
    y = reduce.locally_linear(copies, 2)
    assert np.isfinite(y).all() and np.abs(y - y[::20].repeat(20, axis=0)).max() < 1e-6 and y.std(axis=0).min() > 0.01
    got, mb = most_mb(reduce.locally_linear, rng.normal(size=(2500, 64)), 2)
    assert np.isfinite(got).all() and mb < 300


def plain_shares(x):
    """t-SNE's shares row by row, by halving."""
    d, aim = np.square(np.linalg.norm(x[:, None] - x[None], axis=2)), np.log(min(30, max(5, len(x) - 1)))
    p = np.zeros_like(d)
    for i in range(len(x)):
        lo, hi, b = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-(d[i] - np.delete(d[i], i).min()) * b)
            w[i] = 0
            p[i] = w / w.sum()
            h = -(p[i][p[i] > 0] * np.log(p[i][p[i] > 0])).sum()
            lo, hi = (b, hi) if h > aim else (lo, b)
            b = b * 2 if hi == np.inf else (lo + hi) / 2
    return (p + p.T) / (2 * len(x))


def test_tsne_in_tiles(monkeypatch):
    """Tiles, held or made anew, in blocks and in single precision, against plain rounds over all pairs."""
    rng = np.random.default_rng(7)
    alike = [np.repeat(rng.normal(size=(3, 4)), 40, axis=0), np.eye(60), np.full((50, 3), 0.1)]  # more rows as near as the nearest than the perplexity
    for x, rounds in ((rng.normal(size=(90, 6)), 12), (np.exp(3 * rng.normal(size=(80, 3))), 12), *((x, 3) for x in alike)):
        n = len(x)
        p = np.maximum(plain_shares(x), 1e-12)
        y = np.random.default_rng(0).normal(0, 1e-4, (n, 2))
        step = np.zeros_like(y)
        for _ in range(rounds):
            w = 1 / (1 + np.square(np.linalg.norm(y[:, None] - y[None], axis=2)))
            np.fill_diagonal(w, 0)
            g = (p * 12 - w / w.sum()) * w
            step = 0.5 * step - 50 * 4 * (np.diag(g.sum(axis=1)) - g) @ y
            y = y + step
        want = y - y.mean(axis=0)
        for settings in ({}, {"TILE": 16}, {"TILE": 16, "HELD": 0, "BLOCK": 1 << 9}, {"WHOLE": 10, "TILE": 32}):
            with monkeypatch.context() as m:
                for name, value in settings.items():
                    m.setattr(reduce, name, value)
                assert np.abs(reduce.tsne(x, 2, rounds) - want).max() < 1e-3 * np.abs(want).max(), (n, settings)
    got, mb = most_mb(reduce.tsne, rng.normal(size=(2500, 64)), 2, 3)
    assert np.isfinite(got).all() and mb < 300


def test_model_inputs():
    rng = np.random.default_rng(2)
    image, mask = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8), np.zeros((20, 30))
    mask[6:12, 10:22] = 1
    cut = pixels.contrast_input(image, mask, 255, by=0, size=12)  # 6 x 12, padded to 12 x 12: no resize
    assert (cut[3:9] == image[6:12, 10:22]).all() and (cut[:3] == 255).all() and (cut[9:] == 255).all()
    assert (pixels.contrast_input(image, mask, None, size=12)[3:9] == image[6:12, 10:22]).all()
    seen = pixels.contrast_mask(mask, by=0, size=12)
    assert (seen[3:9] == 255).all() and not seen[:3].any()
    grown = pixels.contrast_mask(mask, by=2, size=16)  # 10 x 16 with a margin of 2
    assert (grown[5:11, 2:14] == 255).all() and grown.sum() == 255 * 72
    alpha = pixels.region_alpha(mask, by=2, size=16)
    assert (alpha[5:11, 2:14] == 255).all() and (alpha[3:5] == 204).all() and (alpha[:3] == 168).all()
    assert not pixels.contrast_mask(np.zeros((9, 9)), size=5).any() and set(np.unique(pixels.region_alpha(np.zeros((9, 9)), size=5))) == {168}


def test_reports_and_payloads(spark, sf):
    chain = {r.pos: r.rejection_reason for r in registry.QUERIES["filter_chain"](spark, sf).collect()}
    text = [r.text for r in registry.QUERIES["prefilter_report"](spark, sf).collect()]
    heads = [list(map(int, __import__("re").findall("[0-9]+", t.split("\n")[0]))) for t in text]
    assert sum(h[0] for h in heads) == len(chain) and sum(h[2] for h in heads) == sum(r is not None for r in chain.values())
    plot = registry.QUERIES["scatter_payload"](spark, sf).collect()
    assert len(plot) == len(chain) and sum(r.step is not None for r in plot) == 10 * SMALL_FRAMES.views and all(r.cluster is not None for r in plot)
    samples = registry.QUERIES["debug_samples"](spark, sf)
    assert len({(r.object_id, r.pos) for r in samples.collect()}) == 12 and samples.collect() == registry.QUERIES["debug_samples"](spark, sf).collect()
    drawn = registry.QUERIES["weighted_sample"](spark, sf).collect()
    assert len({(r.object_id, r.pos) for r in drawn}) == len(drawn) == 40
    from prismark.operators import explore
    from prismark.plans.frames import pool

    found = {(r.object_id, r.cluster): r for r in explore.clusters(pool(spark, sf), 3, "farthest").collect()}
    for r in registry.QUERIES["explorer_text"](spark, sf).collect():
        told = __import__("json").loads(r.text)
        assert told["picks"] == [found[r.object_id, c].pick for c in range(3)] and told["centroids"] == [found[r.object_id, c].medoid for c in range(3)]
