"""Queries over the provided tables, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismark.config import KNOB_TABLE, Config, ScoreRule, set_knobs
from prismark.config import SMALL_FRAMES as CFG
from prismark.functions import robust, vectors
from prismark.operators import evaluate, explore, filters, neighbors, plotdata, quality, reduce, select
from prismark.sources.tables import written
from prismark.plans.frames import PX_SQL, SIDE, ST_SQL, frames, pool, with_descriptor, with_inputs, with_shapes, with_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(df: DataFrame, *plain: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero; columns of `plain` as they are."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" and c not in plain else F.col(c) for c in df.columns])


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stats(spark: SparkSession, sf: str, cfg: Config = CFG) -> DataFrame:
    return with_stats(frames(spark, sf), cfg.kernels)


POOL_SQL = "p as (select label as object_id, vec_id as pos, embedding::double[] as e, 0.5 + 0.5 * embedding[1]::double as q from embeddings)"
DIST_SQL = POOL_SQL + ", d as materialized (select a.object_id, a.pos as i, b.pos as j, 1 - list_cosine_similarity(a.e, b.e) as dist from p a join p b on a.object_id = b.object_id and a.pos <> b.pos)"

# --- joins, sets and lookups -----------------------------------------------------------------------------------------


@query("inner_join_mask", "select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def inner_join_mask(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", "lang").join(_table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("left_join_hand", "select doc_id, lang, quality from documents left join labels using (doc_id)")
def left_join_hand(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", "lang").join(_table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")


@query("quality_lookup_default", "select doc_id, coalesce(quality::double, 1.0) as quality from documents left join labels using (doc_id)")
def quality_lookup_default(spark, sf):
    return _table(spark, sf, "documents").select("doc_id").join(_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(1.0)).alias("quality"))


@query("accepted_minus_selected", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def accepted_minus_selected(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", "source").join(_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_selected", "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_selected(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", "source").join(_table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("cardinality", "select label as object_id, count(*)::bigint as n from embeddings group by label")
def cardinality(spark, sf):
    return pool(spark, sf).groupBy("object_id").agg(F.count("*").alias("n"))


# --- robust populations on tabular statistics ------------------------------------------------------------------------

FIT_SQL = "m as (select event_type, median(value) as center from events group by 1), f as (select event_type, any_value(center) as center, median(abs(value - center)) * 1.4826 as scale from events join m using (event_type) group by 1)"


@query("robust_fit", f"with {FIT_SQL} select event_type, round(center, 6) as center, round(scale, 6) as scale from f")
def robust_fit(spark, sf):
    return _r(robust.robust_fit(_table(spark, sf, "events"), "value", ["event_type"]))


def _fitted_events(spark, sf):
    ev = _table(spark, sf, "events").select("event_id", "event_type", "value")
    return ev.join(robust.robust_fit(ev, "value", ["event_type"]), "event_type")


Z_SQL = "(value - center) / case when scale > 0 then scale else 1 end"


@query("outlier_flags", f"with {FIT_SQL} select event_id, round({Z_SQL}, 6) as z, {Z_SQL} <= -1.2 as low, {Z_SQL} >= 2 as high from events join f using (event_type)")
def outlier_flags(spark, sf):
    z = robust.robust_z(F.col("value"), F.col("center"), F.col("scale"))
    return _r(_fitted_events(spark, sf).select("event_id", z.alias("z"), robust.tail_rejected(z, 1.2).alias("low"), robust.tail_rejected(z, 2.0, "high").alias("high")))


@query("one_sided_weight", f"""with {FIT_SQL} select event_id, round(case when scale <= 0 then (value >= center)::int::double else exp(-0.5 * (greatest(center - value, 0) / scale / 0.3) ** 2) end, 6) + 0.0 as low,
  round(case when scale <= 0 then (value <= center)::int::double else exp(-0.5 * (greatest(value - center, 0) / scale / 0.8) ** 2) end, 6) + 0.0 as high from events join f using (event_type)""")
def one_sided_weight(spark, sf):
    w = lambda soft, bad: robust.one_sided_weight(F.col("value"), F.col("center"), F.col("scale"), soft, bad)
    return _r(_fitted_events(spark, sf).select("event_id", w(0.3, "low").alias("low"), w(0.8, "high").alias("high")))


EVENT_RULE = ScoreRule("value", "value", hard_min=5.0, hard_max=200.0, z=1.0, anchor=100.0)


@query("score_filter_verdict", f"""with {FIT_SQL}, r as (select event_id, value, case when value < 5 or value > 200 then 'value_threshold' when {Z_SQL} <= -1 then 'value_outlier' end as r from events join f using (event_type))
  select event_id, round(case when r like '%threshold' then 0 else least(value / 100.0, 1) end, 6) + 0.0 as score, r is null as passed, coalesce(r, 'value') as reason from r""")
def score_filter_verdict(spark, sf):
    return _r(filters.verdict(_table(spark, sf, "events").select("event_id", "event_type", "value"), EVENT_RULE, ["event_type"]).select("event_id", "score", "passed", "reason"))


@query("outlier_on_score", """with s as (select doc_id, lang, n_chars, least(n_chars / 3000.0, 1) as score from documents), m as (select lang, median(score) as c from s group by 1),
  f as (select lang, any_value(c) as c, median(abs(score - c)) * 1.4826 as sc from s join m using (lang) group by 1)
  select doc_id, case when n_chars < 100 then 'small' when (score - c) / case when sc > 0 then sc else 1 end <= -1 then 'small_outlier' end as rejection_reason from s join f using (lang)""")
def outlier_on_score(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.least(F.col("n_chars") / 3000.0, F.lit(1.0)).alias("score"))
    return filters.outlier_on_score(d, F.col("n_chars") >= 100, F.lit("small"), "score", 1.0, by=["lang"]).select("doc_id", "rejection_reason")


@query("minmax_normalize", "select doc_id, round(case when max(n_chars) over w > min(n_chars) over w then (n_chars - min(n_chars) over w) / (max(n_chars) over w - min(n_chars) over w)::double else 0 end, 6) + 0.0 as scaled from documents window w as (partition by lang)")
def minmax_normalize(spark, sf):
    docs = quality.ranges(_table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"])
    return _r(docs.select("doc_id", quality.minmax(F.col("n_chars"), F.col("low"), F.col("high")).alias("scaled")))


@query("softmax", "with s as (select vec_id, embedding::double[] as e from embeddings), x as (select vec_id, i, exp((e[i] - list_max(e)) / 0.1) as v from s, (select unnest(range(1, 65)) as i)) select vec_id as pos, i::int - 1 as i, round(v / sum(v) over (partition by vec_id), 6) as share from x")
def softmax(spark, sf):
    p = pool(spark, sf).select("pos", vectors.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.1).alias("s"))
    return _r(p.select("pos", F.posexplode("s").alias("i", "share")))


@query("metric_summary", """select event_type, 'value' as stat, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(median(value), 6) as median from events group by 1""")
def metric_summary(spark, sf):
    return _r(quality.summary(_table(spark, sf, "events"), ["value"], ["event_type"]))


@query("infer_embedding_type", """select source, case when s like '%dinov3%' then 'dinov3' when s like '%dinov2%' then 'dinov2' when s like '%siglip2%' then 'siglip2' when s like '%siglip%' then 'siglip' when s like '%moonvit%' then 'moonvit' when s like '%eva%' then 'eva_clip' when s like '%clip%' then 'clip' else 'unknown' end as kind
  from (select source, lower((['x/DINOv3-b', 'DINOv2-l', 'siglip2-so', 'SigLIP', 'MoonViT', 'EVA02-CLIP', 'clip-vit', 'other'])[1 + doc_id % 8]) as s from documents)""")
def infer_embedding_type(spark, sf):
    from prismark.operators.embed import infer_type

    names = F.array(*[F.lit(x) for x in ("x/DINOv3-b", "DINOv2-l", "siglip2-so", "SigLIP", "MoonViT", "EVA02-CLIP", "clip-vit", "other")])
    return _table(spark, sf, "documents").select("source", infer_type(F.get(names, (F.col("doc_id") % 8).cast("int"))).alias("kind"))


# --- pixel statistics ------------------------------------------------------------------------------------------------


def _stat_query(name: str, *cols: str):
    sql = f"with {ST_SQL} select pos, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in cols)} from st"

    @query(name, sql)
    def run(spark, sf):
        return _r(_stats(spark, sf).select("pos", *cols))


for _name, _cols in {
    "morph_dilate": ("dilated",), "morph_erode": ("eroded",), "morph_open_close": ("opened", "closed"), "artifact_fraction": ("artifact_pixels", "artifact_fraction"), "boundary_band": ("band_pixels",),
    "boundary_laplacian_var": ("laplacian",), "boundary_tenengrad": ("tenengrad",), "touches_border": ("touches_border",), "pixel_count": ("pixel_count",), "area_fraction": ("area_fraction",),
    "global_blur": ("global_laplacian", "global_tenengrad"), "edge_contact": ("border_ratio", "edge_top_ratio", "edge_bottom_ratio", "edge_left_ratio", "edge_right_ratio", "edge_ratio"),
    "mask_overlap": ("hand_overlap",), "mask_bbox_centroid": ("y0", "x0", "y1", "x1", "cy", "cx"), "grow_mask": ("grown",),
}.items():
    _stat_query(_name, *_cols)


@query("mask_foreground", f"with {PX_SQL} select pos, y::int * 8 + x::int as i, m::int as on_ from px")
def mask_foreground(spark, sf):
    return frames(spark, sf).select("pos", F.posexplode("mask").alias("i", "on_"))


@query("luma", "select vec_id as pos, floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)::int as gray from (select vec_id, (vec_id * 7) % 256 as r, (vec_id * 13) % 256 as g, (vec_id * 29) % 256 as b from embeddings)")
def luma(spark, sf):
    p = pool(spark, sf).select("pos", (F.col("pos") * 7 % 256).alias("r"), (F.col("pos") * 13 % 256).alias("g"), (F.col("pos") * 29 % 256).alias("b"))
    return p.select("pos", F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int").alias("gray"))


@query("bbox_crop", f"with {ST_SQL} select pos, (case when pixel_count > 0 then y1 - y0 + 1 else 8 end)::int as height, (case when pixel_count > 0 then x1 - x0 + 1 else 8 end)::int as width from st")
def bbox_crop(spark, sf):
    side = lambda a, b: F.when(F.col("pixel_count") > 0, F.col(b) - F.col(a) + 1).otherwise(float(SIDE)).cast("int")
    return _stats(spark, sf).select("pos", side("y0", "y1").alias("height"), side("x0", "x1").alias("width"))


@query("contrast_background", f"with {ST_SQL} select object_id, round(avg(rim_brightness) filter (where rim_pixels > 0), 6) as brightness, case when coalesce(avg(rim_brightness) filter (where rim_pixels > 0), 255) >= 128 then 0 else 255 end as background from st group by 1")
def contrast_background(spark, sf):
    mean = F.avg(F.when(F.col("rim_pixels") > 0, F.col("rim_brightness")))
    return _r(_stats(spark, sf).groupBy("object_id").agg(mean.alias("brightness"), F.when(F.coalesce(mean, F.lit(255.0)) >= 128, 0).otherwise(255).alias("background")))


@query("shape_completeness")
def shape_completeness(spark, sf):
    return _r(with_shapes(frames(spark, sf)))


# --- filters over the frames -----------------------------------------------------------------------------------------


def _fit(stat: str, over: str = "st", tag: str = "") -> str:
    return f"m{tag}_{stat} as (select object_id, median({stat}) as c from {over} group by 1), f{tag}_{stat} as (select object_id, any_value(c) as c{tag}_{stat}, median(abs({stat} - c)) * 1.4826 as s{tag}_{stat} from {over} join m{tag}_{stat} using (object_id) group by 1)"


def _z(stat: str, tag: str = "") -> str:
    return f"({stat} - c{tag}_{stat}) / case when s{tag}_{stat} > 0 then s{tag}_{stat} else 1 end"


_FITS = ", ".join(_fit(r.stat) for r in CFG.rules)
_JOINS = " ".join(f"join f_{r.stat} using (object_id)" for r in CFG.rules)


def _reason_sql(r) -> str:
    out = "case"
    if r.hard_min is not None:
        out += f" when {r.stat} < {r.hard_min} then '{r.name}_threshold'"
    if getattr(r, "hard_max", None) is not None:
        out += f" when {r.stat} > {r.hard_max} then '{r.name}_threshold'"
    if r.z is not None:
        out += f" when {_z(r.stat)} {'<= -' if r.bad == 'low' else '>= '}{r.z} then '{r.name}_outlier'"
    return out + " end"


CHAIN_SQL = f"{ST_SQL}, {_FITS}, ch as materialized (select *, coalesce(case when pixel_count <= 0 then 'vincent_empty_mask' end, {', '.join(_reason_sql(r) for r in CFG.rules)}) as rejection_reason from st {_JOINS})"
_SOFT_R = f"coalesce(rejection_reason, case when laplacian < {CFG.soft[1].hard_min} then 'vincents_motion_blur_threshold' end)"
_W = "case when s1_{0} <= 0 then ({0} >= c1_{0})::int::double else exp(-0.5 * (greatest(c1_{0} - {0}, 0) / s1_{0} / 0.3) ** 2) end"
SOFT_SQL = f"""{CHAIN_SQL}, so as materialized (select * replace ({_SOFT_R} as rejection_reason) from ch), ok as (select * from so where rejection_reason is null), {_fit("area_fraction", "ok", "1")}, {_fit("laplacian", "ok", "1")},
sp as materialized (select so.*, case when rejection_reason is null then {_W.format("area_fraction")} else 0 end as vincents_area, case when rejection_reason is null then {_W.format("laplacian")} else 0 end as vincents_motion_blur
  from so left join f1_area_fraction using (object_id) left join f1_laplacian using (object_id))"""


def _stored(spark, sf) -> DataFrame:
    """The statistics of all frames, written once: populations are fitted, judged and reported from this narrow table, and no frame is read twice."""
    return written(_stats(spark, sf), "stats")


def _chained(spark, sf, cfg: Config = CFG) -> DataFrame:
    return filters.chain(_stored(spark, sf), cfg)


@query("filter_chain", f"with {CHAIN_SQL} select pos, rejection_reason from ch")
def filter_chain(spark, sf):
    return _chained(spark, sf).select("pos", "rejection_reason")


@query("soft_pass", f"with {SOFT_SQL} select pos, rejection_reason, round(vincents_area, 6) + 0.0 as vincents_area, round(vincents_motion_blur, 6) + 0.0 as vincents_motion_blur from sp")
def soft_pass(spark, sf):
    return _r(filters.soft_pass(_chained(spark, sf), CFG).select("pos", "rejection_reason", "vincents_area", "vincents_motion_blur"))


def _rule_query(name: str, rule: ScoreRule):
    bad = f"round(case when r like '%threshold' then 0 else {'least(%s / %s, 1)' % (rule.stat, rule.anchor) if rule.bad == 'low' else 'least(greatest(1 - %s / %s, 0), 1)' % (rule.stat, rule.anchor)} end, 6) + 0.0"
    sql = f"with {ST_SQL}, {_fit(rule.stat)}, r as (select *, {_reason_sql(rule)} as r from st join f_{rule.stat} using (object_id)) select pos, {bad} as score, r is null as passed, coalesce(r, '{rule.name}') as reason from r"

    @query(name, sql)
    def run(spark, sf):
        return _r(filters.verdict(_stored(spark, sf), rule).select("pos", "score", "passed", "reason"))


for _name, _rule in zip(("filter_laplacian", "filter_tenengrad", "filter_artifacts"), CFG.rules, strict=True):
    _rule_query(_name, _rule)


@query("filter_hard_rules", f"""with {ST_SQL} select pos, case when pixel_count <= 0 then 'vincent_empty_mask' end as empty, case when touches_border > 0 then 'vincent_border_pixel' end as border_pixel,
  case when area_fraction < 0.25 then 'small_object' end as small, case when pixel_count <= 0 then 'empty_mask' when border_ratio > 0.05 or edge_ratio > 0.25 then 'border' end as border,
  case when global_laplacian < 20000 or global_tenengrad < 200 then 'blur' end as blur, case when pos % 3 = 0 then null when pixel_count <= 0 then 'empty_mask' when hand_overlap > 0.15 then 'occlusion' end as occlusion from st""")
def filter_hard_rules(spark, sf):
    c = F.col
    st = _stats(spark, sf)
    none = F.lit(None).cast("string")
    return st.select(
        "pos", F.when(c("pixel_count") <= 0, "vincent_empty_mask").alias("empty"), F.when(c("touches_border") > 0, "vincent_border_pixel").alias("border_pixel"),
        filters.small_object(c("area_fraction"), 0.25)[1].alias("small"), filters.border_contact(c("border_ratio"), c("edge_ratio"), c("pixel_count"))[1].alias("border"),
        filters.global_blur(c("global_laplacian"), c("global_tenengrad"), 20000.0, 200.0)[1].alias("blur"), F.coalesce(filters.occlusion(c("hand_overlap"), c("pixel_count"), c("pos") % 3 != 0)[1], none).alias("occlusion"),
    )


@query("filter_scores", f"""with {ST_SQL} select pos, round(least(area_fraction / 0.25, 1), 6) + 0.0 as small, round(case when pixel_count <= 0 then 0 else least(1 - least(border_ratio / 0.05, 1), 1 - least(edge_ratio / 0.25, 1)) end, 6) + 0.0 as border,
  round((least(global_laplacian / 20000, 1) + least(global_tenengrad / 200, 1)) / 2, 6) + 0.0 as blur, round(case when pos % 3 = 0 then 1 when pixel_count <= 0 then 0 else 1 - least(hand_overlap / 0.15, 1) end, 6) + 0.0 as occlusion from st""")
def filter_scores(spark, sf):
    c = F.col
    return _r(_stats(spark, sf).select("pos", filters.small_object(c("area_fraction"), 0.25)[0].alias("small"), filters.border_contact(c("border_ratio"), c("edge_ratio"), c("pixel_count"))[0].alias("border"), filters.global_blur(c("global_laplacian"), c("global_tenengrad"), 20000.0, 200.0)[0].alias("blur"), filters.occlusion(c("hand_overlap"), c("pixel_count"), c("pos") % 3 != 0)[0].alias("occlusion")))


@query("filter_confidence", "select doc_id, case when coalesce(quality::double, 1) < 0.5 then 'confidence' end as reason from documents left join labels using (doc_id)")
def filter_confidence(spark, sf):
    return quality_lookup_default(spark, sf).select("doc_id", filters.confidence(F.col("quality")).alias("reason"))


@query("filter_completeness")
def filter_completeness(spark, sf):
    return with_shapes(frames(spark, sf)).select("pos", filters.completeness_rule(F.col("completeness")).alias("reason"))


@query("reason_parse", f"with {CHAIN_SQL} select pos, regexp_replace(rejection_reason, '_(threshold|outlier)$', '') as base_reason, case when rejection_reason like '%\\_outlier' escape '\\' then 'outlier-based' else 'threshold-based' end as mode from ch where rejection_reason is not null")
def reason_parse(spark, sf):
    r = F.col("rejection_reason")
    return _chained(spark, sf).where(r.isNotNull()).select("pos", filters.base_reason(r).alias("base_reason"), filters.rejection_mode(r).alias("mode"))


@query("rejection_breakdown", f"with {CHAIN_SQL} select coalesce(rejection_reason, 'unknown') as reason, count(*)::bigint as n from ch group by 1")
def rejection_breakdown(spark, sf):
    return _chained(spark, sf).groupBy(F.coalesce("rejection_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("rejections_by_reason_mode", f"with {CHAIN_SQL} select regexp_replace(rejection_reason, '_(threshold|outlier)$', '') as base_reason, case when rejection_reason like '%\\_outlier' escape '\\' then 'outlier-based' else 'threshold-based' end as mode, count(*)::bigint as n from ch where rejection_reason is not null group by rollup (1, 2)")
def rejections_by_reason_mode(spark, sf):
    return reason_parse(spark, sf).rollup("base_reason", "mode").agg(F.count("*").alias("n"))


@query("tune_thresholds", f"""with {ST_SQL} select object_id, round(least(greatest(quantile_cont(area_fraction, 0.01), 0.01), 0.05), 4) as area_minimum_ratio, round(least(greatest(quantile_cont(border_ratio, 0.95), 0.001), 0.05), 4) as border_maximum_ratio,
  round(least(greatest(quantile_cont(edge_ratio, 0.95), 0.05), 0.5), 4) as border_edge_maximum_ratio, round(least(greatest(quantile_cont(laplacian, 0.05), 5), 1000), 1) as laplacian_threshold,
  round(least(greatest(quantile_cont(tenengrad, 0.05), 3), 100), 1) as tenengrad_threshold, round(least(greatest(quantile_cont(hand_overlap, 0.95), 0.001), 0.30), 4) as occlusion_maximum_overlap from st group by 1""")
def tune_thresholds(spark, sf):
    return filters.tune(_stored(spark, sf))


@query("rejected_metrics", f"with {CHAIN_SQL} select pos, rejection_reason as reason, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in ('laplacian', 'tenengrad', 'area_fraction', 'border_ratio', 'edge_ratio', 'hand_overlap', 'pixel_count', 'touches_border', 'artifact_fraction'))} from ch where rejection_reason is not null")
def rejected_metrics(spark, sf):
    return _r(_chained(spark, sf).where("rejection_reason is not null").select("pos", F.col("rejection_reason").alias("reason"), "laplacian", "tenengrad", "area_fraction", "border_ratio", "edge_ratio", "hand_overlap", "pixel_count", "touches_border", "artifact_fraction"))


# --- other orders and knobs ------------------------------------------------------------------------------------------

ORDER = ("vincents_artefacts", "area", "no_such_filter", "blur_tenengrad", "vincents_area", "vincent_empty_mask")
_ORDERED = ", ".join([_reason_sql(CFG.rules[2]), f"case when area_fraction < {CFG.area_minimum} then 'small_object' end", _reason_sql(CFG.rules[1]), "case when pixel_count <= 0 then 'vincent_empty_mask' end"])


@query("filter_order_chain", f"with {ST_SQL}, {_FITS} select pos, coalesce({_ORDERED}) as rejection_reason from st {_JOINS}")
def filter_order_chain(spark, sf):
    """Filters in an order of the caller's; unknown names are warned of, soft rules have their own pass."""
    return filters.chain(_stored(spark, sf), CFG, ORDER).select("pos", "rejection_reason")


KNOBS = {"floors": {"blur_laplacian.hard_min_variance": 150000.0, "vincents_motion_blur.hard_min_variance": 160000.0, "nothing.hard_min": 1.0}, "cutoffs": {"blur_tenengrad.outlier_z": {"enabled": False, "value": 2.0}, "vincents_artefacts.outlier_z": {"enabled": True, "value": 1.25}}, "params": {"vincents_area.softness": 0.8}}
_WHAT = set_knobs(CFG, **KNOBS)
_WHAT_SQL = f"{ST_SQL}, {_FITS}, ch as materialized (select *, coalesce(case when pixel_count <= 0 then 'vincent_empty_mask' end, {', '.join(_reason_sql(r) for r in _WHAT.rules)}, case when laplacian < {_WHAT.soft[1].hard_min} then 'vincents_motion_blur_threshold' end) as rejection_reason from st {_JOINS})"


@query("what_if", f"""with {_WHAT_SQL}, ok as (select * from ch where rejection_reason is null), {_fit("area_fraction", "ok", "1")}
  select pos, rejection_reason, round(case when rejection_reason is null then {_W.format("area_fraction").replace("/ 0.3", "/ 0.8")} else 0 end, 6) + 0.0 as vincents_area from ch left join f1_area_fraction using (object_id)""")
def what_if(spark, sf):
    """Verdicts under other knobs, from stored statistics."""
    return _r(filters.what_if(_stored(spark, sf), CFG, **KNOBS).select("pos", "rejection_reason", "vincents_area"))


@query("what_if_auto", f"""with {ST_SQL}, {_FITS}, t as (select object_id, round(least(greatest(quantile_cont(laplacian, 0.05), 5), 1000), 1) as tl, round(least(greatest(quantile_cont(tenengrad, 0.05), 3), 100), 1) as tt from st group by 1)
  select pos, coalesce(case when pixel_count <= 0 then 'vincent_empty_mask' end, case when laplacian < tl then 'blur_laplacian_threshold' when {_z("laplacian")} <= -2.0 then 'blur_laplacian_outlier' end,
    case when tenengrad < tt then 'blur_tenengrad_threshold' when {_z("tenengrad")} <= -2.0 then 'blur_tenengrad_outlier' end, {_reason_sql(CFG.rules[2])}) as rejection_reason from st {_JOINS} join t using (object_id)""")
def what_if_auto(spark, sf):
    """Verdicts with each object's own tuned floors of blur."""
    return filters.auto_chain(_stored(spark, sf), CFG).select("pos", "rejection_reason")


@query("knob_registry", "select * from (values " + ", ".join(f"('{k}', '{g}', {lo}::double, {hi}::double, {step}::double)" for k, g, lo, hi, step in KNOB_TABLE) + ") as k(knob, grp, low, high, step)")
def knob_registry(spark, sf):
    return spark.createDataFrame([(k, g, float(lo), float(hi), float(step)) for k, g, lo, hi, step in KNOB_TABLE], "knob string, grp string, low double, high double, step double")


# --- model inputs ----------------------------------------------------------------------------------------------------


@query("masked_crop", f"with {ST_SQL}, c as (select pos, sum(case when m then g else 0 end)::bigint as total from px group by 1) select pos, (case when pixel_count > 0 then y1 - y0 + 1 else 8 end)::int as height, (case when pixel_count > 0 then x1 - x0 + 1 else 8 end)::int as width, total from st join c using (pos)")
def masked_crop(spark, sf):
    """The crop to the bounding box on a zero background: its size and the sum of its pixels."""
    made = with_inputs(frames(spark, sf), "masked_crop")
    return made.select("pos", "height", "width", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _input_query(name: str):
    @query(name)
    def run(spark, sf):
        """Rows of pixels of the input a model of 32 x 32 pixels gets; the background is the object's (contrast_background)."""
        return with_inputs(frames(spark, sf).join(written(contrast_background(spark, sf), "background"), "object_id"), name, size=32)


for _name in ("square_crop", "contrast_input", "contrast_alpha", "contrast_mask"):
    _input_query(_name)


# --- quality ---------------------------------------------------------------------------------------------------------

_Q = CFG.quality
_D2 = "least(sqrt((abs(cx - 3.5) / 3.5) ** 2 + (abs(cy - 3.5) / 3.5) ** 2) / sqrt(2), 1)"
_GAP = "least(cy, 7 - cy, cx, 7 - cx)"
QUAL_SQL = f"""qc as materialized (select *, least(laplacian / {_Q.blur_anchor}, 1) as blur, least(area_fraction / {_Q.area_anchor}, 1) as area, case when pixel_count <= 0 then 0 else least(greatest(1 - artifact_fraction / {_Q.artifact_anchor}, 0), 1) end as artefacts,
  case when pixel_count <= 0 then 0 else least(greatest((1 - {_D2} ** 2) * case when {_GAP} < {_Q.border_zone} then exp(({_GAP} - {_Q.border_zone}) * 0.5) else 1 end, 0), 1) end as centerness from sp),
qs as materialized (select *, (blur * 0.3 + area * 0.2 + artefacts * 0.2 + centerness * 0.3) as quality, blur * area * artefacts * centerness as confidence from qc)"""
SCORED_SQL = f"{SOFT_SQL}, {QUAL_SQL}"


def _scored(spark, sf) -> DataFrame:
    return quality.score(filters.soft_pass(_chained(spark, sf), CFG), CFG.quality, SIDE, SIDE)


@query("quality_score", f"with {SCORED_SQL} select pos, round(blur, 6) + 0.0 as blur, round(area, 6) + 0.0 as area, round(artefacts, 6) + 0.0 as vincents_artefacts, round(centerness, 6) + 0.0 as centerness, round(quality, 6) + 0.0 as quality, round(confidence, 6) + 0.0 as confidence from qs")
def quality_score(spark, sf):
    return _r(_scored(spark, sf).select("pos", "blur", "area", "vincents_artefacts", "centerness", "quality", "confidence"))


@query("quality_extra", f"with {ST_SQL} select pos, round(1 - hand_overlap, 6) + 0.0 as occlusion, round(least(area_fraction / 0.2, 1), 6) + 0.0 as anchor_area, round(least(laplacian / 500000, 1), 6) + 0.0 as anchor_motion from st")
def quality_extra(spark, sf):
    return _r(_stats(spark, sf).select("pos", (1 - F.col("hand_overlap")).alias("occlusion"), quality.area(F.col("area_fraction"), 0.2).alias("anchor_area"), quality.blur(F.col("laplacian"), 500000.0).alias("anchor_motion")))


def _floor_sql(src: str, p: float, keep: int, views: int) -> str:
    return f"""fl as (select object_id, case when count(*) <= {views} then min(quality) else least(case when count(*) >= {max(keep, views)} then least(greatest(quantile_cont(quality, {p}), 0), list_sort(list(quality), 'desc')[{max(keep, views)}]) else greatest(quantile_cont(quality, {p}), 0) end, list_sort(list(quality), 'desc')[{views}]) end as floor from {src} group by 1)"""


ACC_SQL = f"{SCORED_SQL}, acc as (select * from qs where rejection_reason is null), {_floor_sql('acc', CFG.floor.percentile, CFG.floor.minimum_pool, CFG.views)}, pl as materialized (select acc.*, e.embedding::double[] as e from acc join fl using (object_id) join embeddings e on e.vec_id = acc.pos where floor <= 0 or quality >= floor)"


def _accepted(spark, sf) -> DataFrame:
    return _scored(spark, sf).where("rejection_reason is null")


def _curated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, pool with embeddings)."""
    acc = written(_accepted(spark, sf).select("object_id", "pos", "quality"), "accepted")
    kept = quality.selection_pool(acc, quality.floors(acc, CFG.floor, CFG.views))
    return acc, kept.join(pool(spark, sf).select("object_id", "pos", "embedding"), ["object_id", "pos"])


@query("quality_floor", f"with {ACC_SQL} select object_id, round(floor, 6) + 0.0 as floor from fl")
def quality_floor(spark, sf):
    return _r(quality.floors(written(_accepted(spark, sf).select("object_id", "pos", "quality"), "accepted"), CFG.floor, CFG.views))


@query("selection_pool", f"with {ACC_SQL} select object_id, pos, round(quality, 6) + 0.0 as quality from pl")
def selection_pool(spark, sf):
    return _r(_curated(spark, sf)[1].select("object_id", "pos", "quality"))


# --- vectors and neighbours ------------------------------------------------------------------------------------------


@query("pairwise_cosine", f"with {DIST_SQL} select object_id, i, j, round(dist, 6) + 0.0 as dist from d where i < j")
def pairwise_cosine(spark, sf):
    p = pool(spark, sf)
    return _r(neighbors.pair_distances(p, p).where("i < j"))


@query("l2_normalize", "with p as (select vec_id as pos, embedding::double[] as e from embeddings), n as (select pos, e, sqrt(list_sum(list_transform(e, lambda x: x * x * 4))) as n from p) select pos, (i - 1)::int as i, round(2 * e[i] / n, 6) + 0.0 as v from n, (select unnest(range(1, 65)) as i)")
def l2_normalize(spark, sf):
    twice = F.transform("embedding", lambda x: 2 * x.cast("double"))
    return _r(pool(spark, sf).select("pos", twice.alias("e")).select("pos", F.posexplode(vectors.l2_normalize(F.col("e"))).alias("i", "v")))


@query("knn_cosine", f"with {DIST_SQL}, r as (select *, row_number() over (partition by object_id, i order by round(dist, 12), j) as rank from d) select object_id, i, rank::int as rank, j, round(dist, 6) + 0.0 as dist from r where rank <= 5")
def knn_cosine(spark, sf):
    p = pool(spark, sf)
    return _r(neighbors.knn(p, p, 5))


@query("knn_cluster_first", f"with {DIST_SQL}, r as (select *, row_number() over (partition by object_id, i order by i % 3 <> j % 3, round(dist, 12), j) as rank from d) select object_id, i, rank::int as rank, j, round(dist, 6) + 0.0 as dist from r where rank <= 5")
def knn_cluster_first(spark, sf):
    p = pool(spark, sf).withColumn("cluster", F.col("pos") % 3)
    return _r(neighbors.knn(p, p, 5, first=True))


@query("nearest_selected", f"with {DIST_SQL}, r as (select *, row_number() over (partition by object_id, i order by round(dist, 12), j) as rank from d where j % 7 = 0 and i % 7 <> 0) select object_id, i as pos, j as nearest, round(dist, 6) + 0.0 as dist from r where rank = 1")
def nearest_selected(spark, sf):
    p = pool(spark, sf)
    return _r(neighbors.nearest_selected(p, p.where("pos % 7 = 0")))


@query("silhouette_divergence", "with p as (select label as object_id, vec_id as pos, embedding[1:32]::double[] as a, embedding[33:64]::double[] as b from embeddings) select pos, round(1 - list_cosine_similarity(a, b), 6) + 0.0 as divergence from p")
def silhouette_divergence(spark, sf):
    return _r(pool(spark, sf).select("pos", vectors.cosine_distance(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("divergence")))


# --- selectors -------------------------------------------------------------------------------------------------------

N = CFG.views


def _greedy_sql(start: str, score: str, agg: str, src: str = POOL_SQL, dist: str = "1 - list_cosine_similarity(a.e, b.e)", n: int = N) -> str:
    """Greedy picks as a recursive query: agg is over the distances (column dist) to the rows picked so far."""
    return f"""with recursive {src}, dd as materialized (select a.object_id, a.pos as i, b.pos as j, {dist} as dist from p a join p b on a.object_id = b.object_id),
g as (
  select object_id, 0 as step, arg_max(pos, ({start}, -pos)) as pos, [arg_max(pos, ({start}, -pos))] as picked from p group by object_id
  union all
  select object_id, step, pos, list_append(picked, pos) as picked from (
    select object_id, step, picked, arg_max(i, (score, -i)) as pos from (
      select g.object_id, g.step + 1 as step, g.picked, p.pos as i, {score} as score
      from g join p on p.object_id = g.object_id and not list_contains(g.picked, p.pos) join dd on dd.object_id = g.object_id and dd.i = p.pos and list_contains(g.picked, dd.j)
      where g.step + 1 < {n} group by g.object_id, g.step, g.picked, p.pos, p.q) group by object_id, step, picked))"""


GQD = lambda agg, src=POOL_SQL, n=N: _greedy_sql("q", f"{CFG.alpha} * p.q + {CFG.beta} * {agg}(dist)", agg, src, n=n)
PICKED = " select object_id, step::int as step, pos from g"


@query("select_gqd_min", GQD("min") + PICKED)
def select_gqd_min(spark, sf):
    return select.select_gqd(pool(spark, sf), N, CFG.alpha, CFG.beta)


@query("select_gqd_max", GQD("max") + PICKED)
def select_gqd_max(spark, sf):
    return select.select_gqd(pool(spark, sf), N, CFG.alpha, CFG.beta, "max")


_DOT = "list_dot_product(a.e, b.e)"


@query("select_gqd_prototype", f"""with recursive {POOL_SQL}, dd as materialized (select a.object_id, a.pos as i, b.pos as j, {_DOT} as dot from p a join p b on a.object_id = b.object_id),
g as (
  select object_id, 0 as step, arg_max(pos, (q, -pos)) as pos, [arg_max(pos, (q, -pos))] as picked, arg_max(list_dot_product(e, e), (q, -pos)) as size from p group by object_id
  union all
  select object_id, step, pos, list_append(picked, pos) as picked, size + 2 * along + own as size from (
    select object_id, step, picked, size, arg_max(i, (score, -i)) as pos, arg_max(along, (score, -i)) as along, arg_max(own, (score, -i)) as own from (
      select g.object_id, g.step + 1 as step, g.picked, g.size, p.pos as i, list_dot_product(any_value(p.e), any_value(p.e)) as own, sum(dot) as along,
        {CFG.alpha} * p.q + {CFG.beta} * (1 - sum(dot) / sqrt(g.size) / sqrt(list_dot_product(any_value(p.e), any_value(p.e)))) as score
      from g join p on p.object_id = g.object_id and not list_contains(g.picked, p.pos) join dd on dd.object_id = g.object_id and dd.i = p.pos and list_contains(g.picked, dd.j)
      where g.step + 1 < {N} group by g.object_id, g.step, g.picked, g.size, p.pos, p.q) group by object_id, step, picked, size))
select object_id, step::int as step, pos from g""")
def select_gqd_prototype(spark, sf):
    return select.select_gqd(pool(spark, sf), N, CFG.alpha, CFG.beta, "prototype")


@query("select_gqd_rounds", GQD("min") + PICKED)
def select_gqd_rounds(spark, sf):
    return select.select_gqd(pool(spark, sf), N, CFG.alpha, CFG.beta, strategy="rounds")


@query("select_gqd_descriptors", f"""with recursive {POOL_SQL}, dd as materialized (select a.object_id, a.pos as i, b.pos as j, 1 - list_cosine_similarity(a.e, b.e) as dist, 1 - list_cosine_similarity(a.e[33:64], b.e[33:64]) as far from p a join p b on a.object_id = b.object_id),
g as (
  select object_id, 0 as step, arg_max(pos, (q, -pos)) as pos, [arg_max(pos, (q, -pos))] as picked from p group by object_id
  union all
  select object_id, step, pos, list_append(picked, pos) as picked from (
    select object_id, step, picked, arg_max(i, (score, -i)) as pos from (
      select g.object_id, g.step + 1 as step, g.picked, p.pos as i, {CFG.alpha} * p.q + {CFG.beta} * (0.5 * min(dist) + 0.5 * min(far)) as score
      from g join p on p.object_id = g.object_id and not list_contains(g.picked, p.pos) join dd on dd.object_id = g.object_id and dd.i = p.pos and list_contains(g.picked, dd.j)
      where g.step + 1 < {N} group by g.object_id, g.step, g.picked, p.pos, p.q) group by object_id, step, picked)) select object_id, step::int as step, pos from g""")
def select_gqd_descriptors(spark, sf):
    return select.select_descriptors(pool(spark, sf).withColumn("shape", F.slice("embedding", 33, 32)), "shape", N, CFG.alpha, CFG.beta)


@query("select_fps", _greedy_sql("-pos", "min(dist)", "min") + PICKED)
def select_fps(spark, sf):
    return select.select_fps(pool(spark, sf), N)


@query("seeds_farthest", _greedy_sql("q", "min(dist)", "min") + PICKED)
def seeds_farthest(spark, sf):
    return select.select_fps(pool(spark, sf), N, start="best")


@query("select_nbv", _greedy_sql("q", "p.q + 0.5 * avg(dist)", "avg", dist="list_distance(a.e, b.e)") + PICKED)
def select_nbv(spark, sf):
    return select.select_nbv(pool(spark, sf), N)


@query("select_facility_location", f"""with recursive {POOL_SQL}, dd as materialized (select a.object_id, a.pos as i, b.pos as j, least(greatest(list_cosine_similarity(a.e, b.e), 0), 1) as sim from p a join p b on a.object_id = b.object_id),
g as (
  select object_id, 0 as step, arg_max(i, (s, -i)) as pos, [arg_max(i, (s, -i))] as picked from (select object_id, i, round(sum(sim), 9) as s from dd group by object_id, i) group by object_id
  union all
  select object_id, step, pos, list_append(picked, pos) as picked from (
    select object_id, step, picked, arg_max(i, (s, -i)) as pos from (
      select object_id, step, picked, i, round(sum(best), 9) as s from (
        select g.object_id, g.step + 1 as step, g.picked, c.i, c.j, greatest(any_value(c.sim), max(o.sim)) as best
        from g join dd c on c.object_id = g.object_id and not list_contains(g.picked, c.i) join dd o on o.object_id = g.object_id and o.i = c.j and list_contains(g.picked, o.j)
        where g.step + 1 < {N} group by g.object_id, g.step, g.picked, c.i, c.j) group by object_id, step, picked, i) group by object_id, step, picked))
select object_id, step::int as step, pos from g""")
def select_facility_location(spark, sf):
    return select.select_facility_location(pool(spark, sf), N)


@query("select_dpp_pair", """with p as (select label as object_id, vec_id as pos, embedding::double[] as e, 0.5 + 0.5 * embedding[1]::double as q from embeddings), a as (select object_id, arg_max(pos, (q * q, -pos)) as pos from p group by 1),
  s as (select p.object_id, p.pos, p.q * p.q * f.q * f.q * (1 - exp(-(1 - list_cosine_similarity(p.e, f.e)) / 0.5) ** 2) as v from p join a on a.object_id = p.object_id and a.pos <> p.pos join p f on f.pos = a.pos)
  select object_id, 0::int as step, pos from a union all select object_id, 1::int as step, arg_max(pos, (v, -pos)) as pos from s group by object_id""")
def select_dpp_pair(spark, sf):
    return select.select_dpp(pool(spark, sf), 2)


@query("select_dpp")
def select_dpp(spark, sf):
    return select.select_dpp(pool(spark, sf), N)


@query("select_kmeans_xnn")
def select_kmeans_xnn(spark, sf):
    return select.select_kmeans_xnn(pool(spark, sf), N)


@query("select_kmeans_fill")
def select_kmeans_fill(spark, sf):
    return select.select_kmeans_xnn(pool(spark, sf), N, k=3, init="farthest")


@query("select_kmeans_xnn_silhouette")
def select_kmeans_xnn_silhouette(spark, sf):
    return select.select_kmeans_xnn(pool(spark, sf).withColumn("shape", F.slice("embedding", 33, 32)), N, shapes="shape")


@query("seeds_quality", f"with {POOL_SQL}, r as (select *, row_number() over (partition by object_id order by q desc, pos) as k from p) select object_id, (k - 1)::int as step, pos from r where k <= {N}")
def seeds_quality(spark, sf):
    k = F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("quality"), "pos"))
    return pool(spark, sf).withColumn("k", k).where(F.col("k") <= N).select("object_id", (F.col("k") - 1).alias("step"), "pos")


_CENTERS = "c as (select object_id, pos % 3 as cluster, pos as cpos, e as ce from p qualify row_number() over (partition by object_id, pos % 3 order by q desc, pos) = 1)"


@query("kmeans_assign", f"with {POOL_SQL}, {_CENTERS}, l as (select p.object_id, p.pos, arg_min(cluster, (round(list_distance(p.e, ce), 9), cluster)) as cluster from p join c using (object_id) group by 1, 2), u as (select l.object_id, cluster, i, avg(e[i]) as v from l join p using (pos), (select unnest(range(1, 65)) as i) group by 1, 2, 3) select object_id, cluster, (i - 1)::int as i, round(v, 6) + 0.0 as v from u")
def kmeans_assign(spark, sf):
    """One step of k-means: rows to their nearest centre, centres to the mean of their rows."""
    p = pool(spark, sf)
    labels = _assigned(p, _centers(p))
    each = labels.join(p.select("pos", "embedding"), "pos").select("object_id", "cluster", F.posexplode("embedding").alias("i", "x"))
    return _r(each.groupBy("object_id", "cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("v")))


def _centers(p: DataFrame) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("object_id", F.col("pos") % 3).orderBy(F.desc("quality"), "pos"))
    return p.withColumn("k", k).where("k = 1").select("object_id", (F.col("pos") % 3).alias("cluster"), F.col("embedding").alias("center"))


def _assigned(p: DataFrame, centers: DataFrame) -> DataFrame:
    far = F.round(vectors.euclidean(F.col("embedding"), F.col("center")), 9)
    return p.join(centers, "object_id").groupBy("object_id", "pos").agg(F.min_by("cluster", F.struct(far, F.col("cluster"))).alias("cluster"))


@query("xnn_candidates", f"with {POOL_SQL}, {_CENTERS}, r as (select p.object_id, c.cluster, p.pos, p.pos % 3 as label, row_number() over (partition by p.object_id, c.cluster order by round(1 - list_cosine_similarity(p.e, ce), 12), p.pos) as k from p join c using (object_id)) select object_id, cluster, pos from r where k <= 6 and label = cluster")
def xnn_candidates(spark, sf):
    p = pool(spark, sf)
    far = F.round(vectors.cosine_distance(F.col("embedding"), F.col("center")), 12)
    k = F.row_number().over(Window.partitionBy("object_id", "cluster").orderBy(far, "pos"))
    return p.join(_centers(p), "object_id").withColumn("k", k).where("k <= 6 and pos % 3 = cluster").select("object_id", "cluster", "pos")


@query("cluster_avg_quality", f"with {POOL_SQL} select object_id, pos % 3 as cluster, round(avg(q), 6) as quality, row_number() over (partition by object_id order by avg(q) desc, pos % 3)::int as rank from p group by 1, 2")
def cluster_avg_quality(spark, sf):
    g = pool(spark, sf).groupBy("object_id", (F.col("pos") % 3).alias("cluster")).agg(F.avg("quality").alias("quality"))
    return _r(g.withColumn("rank", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("quality"), "cluster"))))


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    return reduce.cluster_labels(pool(spark, sf), 5)


@query("explore_kmeans_xnn")
def explore_kmeans_xnn(spark, sf):
    return explore.clusters(pool(spark, sf), 5)


@query("explorer_text")
def explorer_text(spark, sf):
    p = pool(spark, sf)
    return explore.clusters_text(explore.clusters(p, 3, "farthest"), p)


@query("prefilter_report")
def prefilter_report(spark, sf):
    return explore.prefilter_text(written(_chained(spark, sf), "chained"), ["laplacian", "tenengrad", "artifact_fraction"])


@query("bad_examples")
def bad_examples(spark, sf):
    bad = _chained(spark, sf).where("rejection_reason is not null").select("object_id", "pos", "laplacian")
    return explore.worst_examples(frames(spark, sf).join(bad, ["object_id", "pos"]), -F.col("laplacian"), 4, SIDE, SIDE)


@query("embed_mean_pool")
def embed_mean_pool(spark, sf):
    from prismark.operators.embed import MeanPool, embed

    return embed(frames(spark, sf), MeanPool, SIDE, SIDE)


# --- the whole curation ----------------------------------------------------------------------------------------------

_CUR = GQD("min", f"{ACC_SQL}, p as materialized (select object_id, pos, e, quality as q from pl)")
_SEL = _CUR + ", sel as (select g.object_id, g.step, g.pos, p.q, p.e from g join p using (object_id, pos)), pr as (select a.object_id, 1 - list_cosine_similarity(a.e, b.e) as dist from sel a join sel b on a.object_id = b.object_id and a.step < b.step)"
_COV = ", cv2 as (select p.object_id, p.pos, min(1 - list_cosine_similarity(p.e, s.e)) as dist from p join sel s using (object_id) where p.pos not in (select pos from sel) group by 1, 2)"


def _picks(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored rows, pool with embeddings, picks). Each is written once: reports read them several times."""
    scored = written(_scored(spark, sf), "scored")
    acc = scored.where("rejection_reason is null").select("object_id", "pos", "quality")
    kept = quality.selection_pool(acc, quality.floors(acc, CFG.floor, CFG.views))
    kept = written(kept.join(pool(spark, sf).select("object_id", "pos", "embedding"), ["object_id", "pos"]), "pool")
    return scored, kept, written(select.select_gqd(kept, CFG.views, CFG.alpha, CFG.beta), "picks")


@query("curate", _CUR + PICKED)
def curate(spark, sf):
    """Filter, score, floor and select in one plan."""
    return _picks(spark, sf)[2]


@query("intra_set_metrics", _SEL + " select object_id, count(*)::bigint as n_selected, round(coalesce(any_value(a), 0), 6) + 0.0 as mean_distance, round(coalesce(any_value(b), 0), 6) + 0.0 as min_distance, round(coalesce(any_value(c), 0), 6) + 0.0 as max_distance, round(coalesce(any_value(s), 0), 6) + 0.0 as mean_similarity from sel left join (select object_id, avg(dist) as a, min(dist) as b, max(dist) as c, avg(1 - dist) as s from pr group by 1) using (object_id) group by 1")
def intra_set_metrics(spark, sf):
    _, kept, picks = _picks(spark, sf)
    return _r(evaluate.intra_set(kept, picks))


@query("quality_metrics", _SEL + " select object_id, round(avg(q) filter (where s), 6) as selected_mean, round(min(q) filter (where s), 6) as selected_min, round(max(q) filter (where s), 6) as selected_max, round(avg(q), 6) as pool_mean, round(min(q), 6) as pool_min, count(*)::bigint as pool_count from (select p.*, p.pos in (select pos from sel) as s from p) group by 1")
def quality_metrics(spark, sf):
    _, kept, picks = _picks(spark, sf)
    return _r(evaluate.quality_metrics(kept, picks))


@query("coverage_metrics", _SEL + _COV + " select object_id, round(coalesce(avg(dist), 0), 6) as mean_min_distance, round(coalesce(median(dist), 0), 6) as median_min_distance, count(*) filter (where dist <= 0.5)::bigint as within_05, count(*) filter (where dist <= 0.3)::bigint as within_03, count(dist)::bigint as total_unselected from (select distinct object_id from p) left join cv2 using (object_id) group by 1")
def coverage_metrics(spark, sf):
    _, kept, picks = _picks(spark, sf)
    return _r(evaluate.coverage(kept, picks))


@query("selection_log", _SEL + f" select a.object_id, a.step::int as step, a.pos, round(a.q, 6) as quality, round(min(1 - list_cosine_similarity(a.e, b.e)), 6) + 0.0 as min_distance, round({CFG.alpha} * a.q + {CFG.beta} * min(1 - list_cosine_similarity(a.e, b.e)), 6) + 0.0 as score from sel a left join sel b on a.object_id = b.object_id and b.step < a.step group by a.object_id, a.step, a.pos, a.q")
def selection_log(spark, sf):
    _, kept, picks = _picks(spark, sf)
    return _r(evaluate.selection_log(kept, picks, CFG.alpha, CFG.beta))


@query("run_report", _SEL + """ select object_id, total, accepted, rejected, coalesce(pool_count, 0)::bigint as pool_count, coalesce(selected, 0)::bigint as selected, rejected_ids, coalesce(selected_ids, '') as selected_ids
  from (select object_id, count(*)::bigint as total, count(*) filter (where rejection_reason is null)::bigint as accepted, count(*) filter (where rejection_reason is not null)::bigint as rejected, coalesce(string_agg(pos::varchar, ',' order by pos) filter (where rejection_reason is not null), '') as rejected_ids from qs group by 1)
  left join (select object_id, count(*) as pool_count from p group by 1) using (object_id) left join (select object_id, count(*) as selected, string_agg(pos::varchar, ',' order by pos) as selected_ids from sel group by 1) using (object_id)""")
def run_report(spark, sf):
    return evaluate.run_report(*_picks(spark, sf))


@query("quality_report_rows", _SEL + """ select qs.object_id, qs.pos, round(quality, 6) + 0.0 as quality, round(quality, 6) + 0.0 as score, qs.pos in (select pos from p) as in_selection_pool, qs.pos not in (select pos from p) as below_quality_floor, qs.pos in (select pos from sel) as selected,
  round(1 - border_ratio, 6) + 0.0 as border_free, round(laplacian, 6) as laplacian, round(tenengrad, 6) as tenengrad, round(area_fraction, 6) as area_fraction, round(artifact_fraction, 6) as artifact_fraction, round(vincents_area, 6) + 0.0 as vincents_area from qs where rejection_reason is null""")
def quality_report_rows(spark, sf):
    scored, kept, picks = _picks(spark, sf)
    rows = scored.where("rejection_reason is null").join(kept.select("object_id", "pos", F.lit(True).alias("__in")), ["object_id", "pos"], "left").join(picks.select("object_id", "pos", F.lit(True).alias("__sel")), ["object_id", "pos"], "left")
    inside, chosen = F.coalesce("__in", F.lit(False)), F.coalesce("__sel", F.lit(False))
    return _r(rows.select("object_id", "pos", "quality", F.col("quality").alias("score"), inside.alias("in_selection_pool"), (~inside).alias("below_quality_floor"), chosen.alias("selected"), (1 - F.col("border_ratio")).alias("border_free"), "laplacian", "tenengrad", "area_fraction", "artifact_fraction", "vincents_area"))


# --- descriptors, reduction and plot data ----------------------------------------------------------------------------


_HU = ["n20 + n02", "(n20 - n02) ** 2 + 4 * n11 ** 2", "(n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2", "a ** 2 + b ** 2", "(n30 - 3 * n12) * a * (a * a - 3 * b * b) + (3 * n21 - n03) * b * (3 * a * a - b * b)", "(n20 - n02) * (a * a - b * b) + 4 * n11 * a * b", "(3 * n21 - n03) * a * (a * a - 3 * b * b) - (n30 - 3 * n12) * b * (3 * a * a - b * b)"]


@query("hu_moments", f"""with {PX_SQL}, c as (select pos, count(*) as n, avg(x) as cx, avg(y) as cy from px where m group by 1),
n as (select pos, {', '.join(f'sum((x - cx) ** {i} * (y - cy) ** {j}) / any_value(n) ** {1 + (i + j) / 2} as n{i}{j}' for i, j in ((2, 0), (0, 2), (1, 1), (3, 0), (2, 1), (1, 2), (0, 3)))} from px join c using (pos) where m group by pos),
h as (select *, n30 + n12 as a, n21 + n03 as b from n),
v as (select pos, {', '.join(f'{e} as h{k}' for k, e in enumerate(_HU))} from h)
select vec_id as pos, {', '.join(f'round(coalesce(-(case when abs(h{k}) < 1e-14 then 0 else sign(h{k}) end) * ln(abs(h{k}) + 1e-10), 0), 4) + 0.0 as h{k}' for k in range(7))} from embeddings left join v on v.pos = vec_id""")
def hu_moments(spark, sf):
    """All seven; what only rounding makes differ from zero, a moment under 1e-14, is zero. Smaller moments have longer logarithms."""
    found = with_descriptor(frames(spark, sf), "hu")
    v = lambda k: F.get("embedding", F.lit(k))
    zero = -math.log(1e-14 + 1e-10)
    return _r(found.select("pos", *[F.when(F.abs(v(k)) > zero, 0.0).otherwise(v(k)).alias(f"h{k}") for k in range(7)]), digits=4)


def _descriptor_query(name: str, kind: str):
    @query(name)
    def run(spark, sf):
        found = with_descriptor(frames(spark, sf), kind)
        return found.select("object_id", "pos", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


for _name, _kind in {"hu_vector": "hu", "zernike": "zernike", "fourier_descriptor": "fourier", "shape_context": "shape_context", "silhouette": "silhouette"}.items():
    _descriptor_query(_name, _kind)


@query("pca")
def pca(spark, sf):
    return reduce.pca(pool(spark, sf), 2)


@query("pca_3d")
def pca_3d(spark, sf):
    return reduce.pca(pool(spark, sf), 3)


@query("pca_explained")
def pca_explained(spark, sf):
    """(axis, share): how much of the variance each of three axes explains."""
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(reduce.pca_axes(pool(spark, sf), 3)[2])], "axis int, share double")


@query("mds")
def mds(spark, sf):
    return reduce.by_object(pool(spark, sf), "mds_cosine")


def _reduction_query(name: str, method: str):
    @query(name)
    def run(spark, sf):
        return reduce.by_object(pool(spark, sf), method)


for _name, _method in {"mds_euclidean": "mds", "tsne": "tsne", "isomap": "isomap", "locally_linear": "lle"}.items():
    _reduction_query(_name, _method)


@query("discriminants")
def discriminants(spark, sf):
    """Linear discriminants of each object's clusters."""
    p = pool(spark, sf)
    return reduce.by_object(p.join(reduce.cluster_labels(p, 4), ["object_id", "pos"]), "lda", labels="cluster")


@query("scatter_payload")
def scatter_payload(spark, sf):
    p = pool(spark, sf)
    return plotdata.scatter(reduce.pca(p, 2), p, written(select.select_gqd(p, N, CFG.alpha, CFG.beta), "picks"), reduce.cluster_labels(p, 4))


@query("debug_samples")
def debug_samples(spark, sf):
    return plotdata.debug_samples(pool(spark, sf))


_HS = ("laplacian", "tenengrad", "artifact_fraction", "area_fraction")
#: The raw statistics that reports draw.
RAW = ("laplacian", "tenengrad", "global_laplacian", "global_tenengrad", "area_fraction", "pixel_count", "touches_border", "artifact_fraction", "band_pixels", "border_ratio", "edge_ratio", "hand_overlap")
_LONG_RAW = f"{CHAIN_SQL}, lg as (select pos, object_id, rejection_reason, rejection_reason is null as ok, unnest([{', '.join(repr(s) for s in RAW)}]) as stat, unnest([{', '.join(RAW)}]) as v from ch)"
_LONG = f"{CHAIN_SQL}, lg as (select pos, object_id, rejection_reason is null as ok, unnest([{', '.join(repr(s) for s in _HS)}]) as stat, unnest([{', '.join(_HS)}]) as v from ch)"


@query("hist_raw_stats", f"with {_LONG_RAW}, r as (select stat, min(v) as lo, max(v) as hi from lg group by 1), b as (select stat, case when ok then 'accepted' else 'rejected' end as grp, lo, hi, case when hi > lo then least(floor((v - lo) / ((hi - lo) / 30)), 29) else 0 end::int as bin from lg join r using (stat)) select stat, grp, bin, round(lo + bin * ((hi - lo) / 30), 6) + 0.0 as \"left\", round(lo + (bin + 1) * ((hi - lo) / 30), 6) + 0.0 as \"right\", count(*)::bigint as n from b group by all")
def hist_raw_stats(spark, sf):
    group = F.when(F.col("rejection_reason").isNull(), "accepted").otherwise("rejected")
    return _r(plotdata.histogram(_chained(spark, sf), list(RAW), 30, group))


@query("hist_weights", f"with {SOFT_SQL}, lg as (select 'vincents_area' as stat, vincents_area as v from sp union all select 'vincents_motion_blur', vincents_motion_blur from sp union all select 'both', vincents_area * vincents_motion_blur from sp) select stat, 'all' as grp, least(floor(v / (1.025 / 41)), 40)::int as bin, round(least(floor(v / (1.025 / 41)), 40) * (1.025 / 41), 6) + 0.0 as \"left\", round((least(floor(v / (1.025 / 41)), 40) + 1) * (1.025 / 41), 6) as \"right\", count(*)::bigint as n from lg group by all")
def hist_weights(spark, sf):
    weighed = filters.soft_pass(_chained(spark, sf), CFG).withColumn("both", F.col("vincents_area") * F.col("vincents_motion_blur"))
    return _r(plotdata.histogram(weighed, ["vincents_area", "vincents_motion_blur", "both"], 41, None, 0.0, 1.025))


_OV = ("laplacian", "area_fraction", "hand_overlap")


@query("hist_overview", f"""with {CHAIN_SQL}, lg as (select rejection_reason, unnest([{', '.join(repr(x) for x in _OV)}]) as stat, unnest([{', '.join(_OV)}]) as v from ch),
  r as (select stat, stat in ('area_fraction', 'hand_overlap') as fixed, case when fixed then 0 when min(v) < max(v) then min(v) else min(v) - 0.5 end as lo, case when fixed then 1.025 when min(v) < max(v) then max(v) else max(v) + 0.5 end as hi, case when fixed then 41 else 40 end as many from lg group by stat),
  s as (select stat, unnest(case when rejection_reason is null then ['accepted'] else ['rejected', rejection_reason] end) as series, v from lg)
  select stat, series, least(floor((v - lo) / ((hi - lo) / many)), many - 1)::int as bin, round(lo + bin * ((hi - lo) / many), 6) + 0.0 as "left", round(lo + (bin + 1) * ((hi - lo) / many), 6) + 0.0 as "right", count(*)::bigint as n from s join r using (stat) where v between lo and hi group by all""")
def hist_overview(spark, sf):
    return _r(plotdata.overview(written(_chained(spark, sf), "chained"), list(_OV), ("area_fraction", "hand_overlap")))


@query("goodness", f"with {ST_SQL}, w as (select pos, object_id, area_fraction as area, artifact_fraction as v, min(artifact_fraction) over (partition by object_id) as lo, max(artifact_fraction) over (partition by object_id) as hi from st) select pos, round(1 - v, 6) + 0.0 as reported, round(case when hi > lo then 1 - (v - lo) / (hi - lo) else 0.5 end, 6) + 0.0 as goodness, floor(lo * 100) / 100 as low, ceil(hi * 100) / 100 as high, round(area, 6) + 0.0 as absolute from w")
def goodness(spark, sf):
    v = F.col("artifact_fraction")
    st = quality.ranges(_stored(spark, sf), "artifact_fraction", ["object_id"])
    low, high = plotdata.round_range(F.col("low"), F.col("high"))
    return _r(st.select("pos", plotdata.reported(v, True).alias("reported"), plotdata.goodness(v, F.col("low"), F.col("high"), True).alias("goodness"), low.alias("low"), high.alias("high"), plotdata.absolute_goodness(F.col("area_fraction")).alias("absolute")))


@query("sequence_series", f"with {CHAIN_SQL} select object_id, pos, rejection_reason is null as accepted, (row_number() over (partition by object_id order by pos) - 1)::int as seq from ch")
def sequence_series(spark, sf):
    ch = _chained(spark, sf).select("object_id", "pos", "rejection_reason")
    return plotdata.sequence(ch.where("rejection_reason is null").drop("rejection_reason"), ch.where("rejection_reason is not null").drop("rejection_reason"), ["object_id"])


@query("violin_long", f"with {_LONG}, r as (select stat, min(v) as lo, max(v) as hi from lg group by 1) select case when ok then 'accepted' else 'rejected' end as grp, object_id, pos, stat, round(case when hi > lo then (v - lo) / (hi - lo) else 0 end, 6) + 0.0 as value from lg join r using (stat)")
def violin_long(spark, sf):
    return _r(plotdata.violin_long(_chained(spark, sf), list(_HS), F.when(F.col("rejection_reason").isNull(), "accepted").otherwise("rejected")))


#: Criteria of accepted rows, as far as SQL has them; those of the outline (solidity to completeness) come on top.
CRITERIA = ("laplacian", "tenengrad", "area_fraction", "border_ratio", "edge_ratio", "hand_overlap", "artifact_fraction", "blur", "area", "vincents_artefacts", "centerness", "confidence")
OUTLINE = ("solidity", "extent", "convexity", "completeness")
_CRIT = "case when max({0}) over () - min({0}) over () < 1e-12 then {0} - min({0}) over () else ({0} - min({0}) over ()) / (max({0}) over () - min({0}) over ()) end"


def _criteria(rows: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    scaled = [((F.col(c) - F.col(f"lo_{c}")) / F.when(span(c) < 1e-12, 1.0).otherwise(span(c))).alias(c) for c in cols]
    return rows.crossJoin(F.broadcast(ends)).select("object_id", "pos", *scaled)  # one row of bounds


@query("criteria_matrix", f"with {SCORED_SQL}, q as (select object_id, pos, {', '.join('vincents_artefacts' if c == 'vincents_artefacts' else c for c in CRITERIA)} from (select * exclude (artefacts), artefacts as vincents_artefacts from qs) where rejection_reason is null) select object_id, pos, {', '.join(f'round({_CRIT.format(c)}, 6) + 0.0 as {c}' for c in CRITERIA)} from q")
def criteria_matrix(spark, sf):
    return _r(_criteria(written(_accepted(spark, sf), "accepted"), CRITERIA))


@query("criteria_matrix_outline")
def criteria_matrix_outline(spark, sf):
    """All criteria of rows that have each of them, those of the outline included."""
    rows = _accepted(spark, sf).join(with_shapes(frames(spark, sf)), ["object_id", "pos"]).where("completeness is not null")
    return _r(_criteria(written(rows, "criteria"), (*CRITERIA, *OUTLINE)))


@query("weighted_sample")
def weighted_sample(spark, sf):
    return plotdata.weighted_sample(pool(spark, sf).select("object_id", "pos", "quality"), 1 - F.col("quality"), 4)


@query("rejection_labels", f"with {CHAIN_SQL} select case regexp_replace(rejection_reason, '_(threshold|outlier)$', '') when 'vincent_empty_mask' then 'Empty mask' when 'blur_laplacian' then 'Boundary blur (Laplacian)' when 'blur_tenengrad' then 'Boundary blur (Tenengrad)' when 'vincents_artefacts' then 'Mask artifacts' else 'Other' end as label, count(*)::bigint as n from ch where rejection_reason is not null group by 1")
def rejection_labels(spark, sf):
    labels = {"vincent_empty_mask": "Empty mask", "blur_laplacian": "Boundary blur (Laplacian)", "blur_tenengrad": "Boundary blur (Tenengrad)", "vincents_artefacts": "Mask artifacts"}
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("base_reason")), F.lit("Other"))
    return reason_parse(spark, sf).groupBy(name.alias("label")).agg(F.count("*").alias("n"))
