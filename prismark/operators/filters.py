"""Row filters: reasons as nullable columns, population rules fitted for each object, the first reason wins."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.config import Config, ScoreRule, SoftRule, set_knobs
from prismark.functions.quantiles import quantiles
from prismark.functions.robust import clip, one_sided_weight, robust_fit, robust_fits, robust_z, tail_rejected
from prismark.sources.tables import written

OBJECT = ["object_id"]


def rule_score(rule: ScoreRule | SoftRule, stat: Column) -> Column:
    if getattr(rule, "bad", "low") == "high":
        return clip(1 - stat / rule.anchor, 0.0, 1.0)
    return F.least(stat / rule.anchor, F.lit(1.0))


def rule_reason(rule: ScoreRule | SoftRule, stat: Column, z: Column | None) -> Column:
    """name_threshold beyond a hard limit, else name_outlier in the bad tail, else null."""
    out = F.when(F.lit(False), F.lit(""))
    if rule.hard_min is not None and (isinstance(rule, ScoreRule) or rule.hard_min > 0):
        out = out.when(stat < rule.hard_min, F.lit(f"{rule.name}_threshold"))
    if getattr(rule, "hard_max", None) is not None:
        out = out.when(stat > rule.hard_max, F.lit(f"{rule.name}_threshold"))
    if rule.z is not None and z is not None:
        out = out.when(tail_rejected(z, rule.z, getattr(rule, "bad", "low")), F.lit(f"{rule.name}_outlier"))
    return out


def with_fits(df: DataFrame, rules: list, by: list[str] = OBJECT, where: Column | None = None) -> DataFrame:
    """df with center_ and scale_ columns of each rule's statistic, fitted over the whole population (or `where`) at once."""
    stats = list(dict.fromkeys(r.stat for r in rules))
    return df.join(robust_fits(df if where is None else df.where(where), stats, by), by, "left") if stats else df


def rule_z(rule) -> Column:
    return robust_z(F.col(rule.stat), F.col(f"center_{rule.stat}"), F.col(f"scale_{rule.stat}"))


def verdict(df: DataFrame, rule: ScoreRule, by: list[str] = OBJECT) -> DataFrame:
    """df with score, passed and reason of one rule; a passing row's reason is the rule's name, a threshold's score 0."""
    fitted = with_fits(df, [rule], by) if rule.z is not None else df
    reason = rule_reason(rule, F.col(rule.stat), rule_z(rule) if rule.z is not None else None)
    if not rule.enabled:
        return df.withColumn("score", F.lit(1.0)).withColumn("passed", F.lit(True)).withColumn("reason", F.lit(""))
    marked = fitted.withColumn("__r", reason)
    score = F.when(F.col("__r").endswith("_threshold"), 0.0).otherwise(rule_score(rule, F.col(rule.stat)))
    return marked.withColumn("score", score).withColumn("passed", F.col("__r").isNull()).withColumn("reason", F.coalesce("__r", F.lit(rule.name))).drop("__r", f"center_{rule.stat}", f"scale_{rule.stat}")


EMPTY, BORDER = "vincent_empty_mask", "vincent_border_pixel"  # names that results must have (fixed values)


def default_order(cfg: Config) -> tuple[str, ...]:
    return (*([EMPTY] if cfg.empty else []), *([BORDER] if cfg.border else []), *(r.name for r in cfg.rules))


def chain(df: DataFrame, cfg: Config, order: tuple[str, ...] | None = None) -> DataFrame:
    """df with rejection_reason (null: accepted), the first reason in order: by default empty masks, border contact, then the rules.

    order names filters in any order: those of the default, and area, border, occlusion, confidence and completeness
    (where df has their statistics). Names of soft rules are skipped here (soft_pass has them); unknown names are warned
    of and skipped. All rules are fitted over the whole population, in one go, before any row goes."""
    order = default_order(cfg) if order is None else order
    rules = {r.name: r for r in cfg.rules if r.enabled}
    fitted = with_fits(df, [rules[n] for n in order if n in rules and rules[n].z is not None])
    c = F.col
    plain = {EMPTY: lambda: F.when(c("pixel_count") <= 0, F.lit(EMPTY)), BORDER: lambda: F.when(c("touches_border") > 0, F.lit(BORDER)), "area": lambda: small_object(c("area_fraction"), cfg.area_minimum)[1]}
    plain |= {"border": lambda: border_contact(c("border_ratio"), c("edge_ratio"), c("pixel_count"))[1], "occlusion": lambda: occlusion(c("hand_overlap"), c("pixel_count"), c("has_hand") if "has_hand" in df.columns else F.lit(True))[1]}
    plain |= {"confidence": lambda: confidence(c("confidence")), "completeness": lambda: completeness_rule(c("completeness"))}
    off, reasons = {r.name for r in cfg.rules} | {r.name for r in cfg.soft}, []
    for name in order:
        if name in rules:
            r = rules[name]
            reasons.append(rule_reason(r, c(r.stat), rule_z(r) if r.z is not None else None))
        elif name in plain:
            reasons.append(plain[name]())
        elif name not in off:
            warnings.warn(f"unknown filter {name!r} is skipped", stacklevel=2)
    fits = [x for x in fitted.columns if x.startswith(("center_", "scale_"))]
    return fitted.withColumn("rejection_reason", F.coalesce(*reasons, F.lit(None).cast("string"))).drop(*fits)


def soft_pass(df: DataFrame, cfg: Config, order: tuple[str, ...] | None = None) -> DataFrame:
    """Soft rules after the chain: they may reject rows still accepted, and weigh those accepted then.

    With an order, only the soft rules it names. Tail tests are fitted on all rows, weights on accepted ones; rejected rows' weights are 0."""
    soft = [r for r in cfg.soft if order is None or r.name in order]
    if not soft:
        return df
    fitted = with_fits(df, [r for r in soft if r.z is not None]) if any(r.z is not None for r in soft) else df
    reasons = [rule_reason(r, F.col(r.stat), rule_z(r) if r.z is not None else None) for r in soft]
    out = fitted.withColumn("rejection_reason", F.coalesce("rejection_reason", *reasons)).drop(*[c for c in fitted.columns if c.startswith(("center_", "scale_"))])
    fitted = with_fits(out, soft, where=F.col("rejection_reason").isNull())
    for r in soft:
        w = one_sided_weight(F.col(r.stat), F.col(f"center_{r.stat}"), F.col(f"scale_{r.stat}"), r.softness)
        fitted = fitted.withColumn(r.weight, F.when(F.col("rejection_reason").isNull(), w).otherwise(0.0))
    return fitted.drop(*[c for c in fitted.columns if c.startswith(("center_", "scale_"))])


def base_reason(reason: Column) -> Column:
    return F.regexp_replace(reason, "_(threshold|outlier)$", "")


def rejection_mode(reason: Column) -> Column:
    return F.when(reason.endswith("_outlier"), F.lit("outlier-based")).otherwise(F.lit("threshold-based"))


def outlier_on_score(df: DataFrame, passed: Column, reason: Column, score: str, z: float, bad: str = "low", by: list[str] = OBJECT) -> DataFrame:
    """Wraps any filter: what it rejects stays rejected; of the rest, tail scores are rejected as reason + _outlier."""
    fit = robust_fit(df, score, by).withColumnsRenamed({"center": "__c", "scale": "__s"})
    out = df.join(fit, by, "left")
    tail = tail_rejected(robust_z(F.col(score), F.col("__c"), F.col("__s")), z, bad)
    return out.withColumn("rejection_reason", F.when(~passed, reason).when(tail, F.concat(reason, F.lit("_outlier")))).drop("__c", "__s")


def tune(df: DataFrame, by: list[str] = OBJECT) -> DataFrame:
    """Thresholds from percentiles of the statistics, held within safe limits (fixed values), one row for each object."""
    spec = [  # name, statistic, percentile, least, most, digits
        ("area_minimum_ratio", "area_fraction", 0.01, 0.01, 0.05, 4),
        ("border_maximum_ratio", "border_ratio", 0.95, 0.001, 0.05, 4),
        ("border_edge_maximum_ratio", "edge_ratio", 0.95, 0.05, 0.5, 4),
        ("laplacian_threshold", "laplacian", 0.05, 5.0, 1000.0, 1),
        ("tenengrad_threshold", "tenengrad", 0.05, 3.0, 100.0, 1),
        ("occlusion_maximum_overlap", "hand_overlap", 0.95, 0.001, 0.30, 4),
    ]
    if "completeness" in df.columns:
        spec.append(("completeness_minimum_score", "completeness", 0.01, 0.50, 0.80, 4))
    found = quantiles(df, by, [(name, stat, p) for name, stat, p, *_ in spec])
    return found.select(*by, *[F.round(clip(F.col(name), lo, hi), digits).alias(name) for name, _, _, lo, hi, digits in spec])


def small_object(ratio: Column, least: float = 0.01) -> tuple[Column, Column]:
    """(score, reason) of the legacy area rule."""
    return F.least(ratio / least, F.lit(1.0)), F.when(ratio < least, F.lit("small_object"))


def border_contact(ring: Column, edge: Column, pixels: Column, ring_max: float = 0.05, edge_max: float = 0.25) -> tuple[Column, Column]:
    score = F.least(1 - F.least(ring / ring_max, F.lit(1.0)), 1 - F.least(edge / edge_max, F.lit(1.0)))
    reason = F.when(pixels <= 0, F.lit("empty_mask")).when((ring > ring_max) | (edge > edge_max), F.lit("border"))
    return F.when(pixels <= 0, 0.0).otherwise(score), reason


def global_blur(laplacian: Column, tenengrad: Column, lap_min: float = 120.0, ten_min: float = 35.0) -> tuple[Column, Column]:
    score = (F.least(laplacian / lap_min, F.lit(1.0)) + F.least(tenengrad / ten_min, F.lit(1.0))) / 2
    return score, F.when((laplacian < lap_min) | (tenengrad < ten_min), F.lit("blur"))


def occlusion(overlap: Column, pixels: Column, has_hand: Column, most: float = 0.15) -> tuple[Column, Column]:
    score = F.when(~has_hand, 1.0).when(pixels <= 0, 0.0).otherwise(1 - F.least(overlap / most, F.lit(1.0)))
    return score, F.when(~has_hand, F.lit(None)).when(pixels <= 0, F.lit("empty_mask")).when(overlap > most, F.lit("occlusion"))


def confidence(value: Column, least: float = 0.5) -> Column:
    """Reason of the confidence rule; a row without one passes."""
    return F.when(F.coalesce(value, F.lit(1.0)) < least, F.lit("confidence"))


def completeness_rule(value: Column, least: float = 0.65) -> Column:
    return F.when(value.isNull(), F.lit("empty_mask")).when(value < least, F.lit("incomplete_shape"))


def auto_chain(df: DataFrame, cfg: Config) -> DataFrame:
    """chain() with each object's own floors of both blur rules, as tune() finds them (tuned floors are never under 0)."""
    tuned = {"blur_laplacian": "laplacian_threshold", "blur_tenengrad": "tenengrad_threshold"}
    floors = written(tune(df).select(*OBJECT, *tuned.values()), "tuned")
    open_ = replace(cfg, rules=tuple(replace(r, hard_min=None) if r.name in tuned else r for r in cfg.rules))
    fitted = with_fits(df.join(floors, OBJECT), [r for r in open_.rules if r.enabled and r.z is not None])
    reasons = [F.when(F.col("pixel_count") <= 0, F.lit(EMPTY))] if cfg.empty else []
    reasons += [F.when(F.col("touches_border") > 0, F.lit(BORDER))] if cfg.border else []
    for r in open_.rules:
        if r.enabled:
            if r.name in tuned:
                reasons.append(F.when(F.col(r.stat) < F.col(tuned[r.name]), F.lit(f"{r.name}_threshold")))
            reasons.append(rule_reason(r, F.col(r.stat), rule_z(r) if r.z is not None else None))
    extra = [x for x in fitted.columns if x.startswith(("center_", "scale_"))] + list(tuned.values())
    return fitted.withColumn("rejection_reason", F.coalesce(*reasons, F.lit(None).cast("string"))).drop(*extra)


def what_if(stats: DataFrame, cfg: Config, order: tuple[str, ...] | None = None, floors: dict | None = None, cutoffs: dict | None = None, params: dict | None = None) -> DataFrame:
    """Verdicts under other knobs, over stored statistics: no frame is read again.

    Knobs are those of config.KNOB_TABLE. Kernel sizes change the statistics themselves, so that they are an error here."""
    changed = set_knobs(cfg, floors, cutoffs, params)
    if changed.kernels != cfg.kernels:
        raise ValueError("kernel sizes change the statistics: compute these anew")
    out = chain(stats, changed, order)
    return soft_pass(out, changed, order)
