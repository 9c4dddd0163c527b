"""Settings as frozen records; defaults are those that real frames are judged by (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ScoreRule:
    """A population rule over one statistic: hard limits first (strict), then a tail test in robust scales (inclusive)."""

    name: str
    stat: str
    hard_min: float | None = None
    hard_max: float | None = None
    z: float | None = None
    bad: str = "low"
    anchor: float = 1.0  # the statistic that scores 1 (low is bad) or 0 (high is bad)
    enabled: bool = True


@dataclass(frozen=True)
class SoftRule:
    """A rule that also gives accepted rows a weight."""

    name: str
    stat: str
    weight: str
    hard_min: float | None = None
    z: float | None = None
    softness: float = 0.3
    anchor: float = 1.0


@dataclass(frozen=True)
class Kernels:
    stroke: int = 9
    artifact: int = 10
    ring: int = 2


@dataclass(frozen=True)
class Quality:
    blur_anchor: float = 10000.0
    area_anchor: float = 0.20
    artifact_anchor: float = 0.05
    border_zone: float = 20.0
    weights: tuple[tuple[str, float], ...] = (("blur", 0.30), ("area", 0.20), ("vincents_artefacts", 0.20), ("centerness", 0.30))


@dataclass(frozen=True)
class Floor:
    percentile: float = 0.10
    minimum_pool: int = 30
    absolute_min: float = 0.0


@dataclass(frozen=True)
class Config:
    kernels: Kernels = Kernels()
    rules: tuple[ScoreRule, ...] = (
        ScoreRule("blur_laplacian", "laplacian", hard_min=4200.0, z=2.0, anchor=20000.0),
        ScoreRule("blur_tenengrad", "tenengrad", hard_min=72.5, z=2.0, anchor=150.0),
        ScoreRule("vincents_artefacts", "artifact_fraction", hard_max=0.15, z=2.0, bad="high", anchor=0.05),
    )
    soft: tuple[SoftRule, ...] = (
        SoftRule("vincents_area", "area_fraction", "vincents_area", anchor=0.20),
        SoftRule("vincents_motion_blur", "laplacian", "vincents_motion_blur", hard_min=120.0, anchor=10000.0),
    )
    empty: bool = True
    border: bool = True
    quality: Quality = Quality()
    floor: Floor = Floor()
    area_minimum: float = 0.01
    views: int = 10
    alpha: float = 0.60
    beta: float = 0.40


#: Settings for the 8 x 8 frames that the vector table encodes: same rules, scales of that encoding.
SMALL_FRAMES = Config(
    kernels=Kernels(stroke=3, artifact=3, ring=1),
    rules=(
        ScoreRule("blur_laplacian", "laplacian", hard_min=215000.0, z=2.0, anchor=500000.0),
        ScoreRule("blur_tenengrad", "tenengrad", hard_min=204.0, z=2.0, anchor=350.0),
        ScoreRule("vincents_artefacts", "artifact_fraction", hard_max=1.73, z=2.0, bad="high", anchor=2.0),
    ),
    soft=(SoftRule("vincents_area", "area_fraction", "vincents_area", anchor=0.40), SoftRule("vincents_motion_blur", "laplacian", "vincents_motion_blur", hard_min=220000.0, anchor=500000.0)),
    border=False,
    quality=Quality(blur_anchor=500000.0, area_anchor=0.40, artifact_anchor=2.0, border_zone=1.0),
    floor=Floor(percentile=0.10, minimum_pool=20),
    views=5,
)

KNOBS: dict[str, tuple[float, float]] = {"hard_min": (0.0, 1e6), "hard_max": (0.0, 10.0), "z": (0.5, 10.0)}


def apply_knobs(cfg: Config, knobs: dict[str, dict[str, float | None]]) -> Config:
    """cfg with rules changed by name: {rule: {hard_min | hard_max | z: value or None}}. Unknown rules and knobs are ignored."""
    def changed(rule):
        asked = {k: v for k, v in knobs.get(rule.name, {}).items() if k in KNOBS and hasattr(rule, k)}
        return replace(rule, **{k: None if v is None else min(max(float(v), KNOBS[k][0]), KNOBS[k][1]) for k, v in asked.items()})

    return replace(cfg, rules=tuple(map(changed, cfg.rules)), soft=tuple(map(changed, cfg.soft)))


def config_payload(cfg: Config) -> dict:
    return {r.name: {k: getattr(r, k) for k in KNOBS if hasattr(r, k)} for r in (*cfg.rules, *cfg.soft)}


#: key, group, least, most, step of every knob (fixed values).
KNOB_TABLE: tuple[tuple[str, str, float, float, float], ...] = (
    ("blur_laplacian.hard_min_variance", "floor", 0.0, 50000.0, 100.0),
    ("blur_tenengrad.hard_min_tenengrad", "floor", 0.0, 1000.0, 1.0),
    ("vincents_artefacts.hard_max_fraction", "floor", 0.0, 1.0, 0.005),
    ("vincents_motion_blur.hard_min_variance", "floor", 0.0, 50000.0, 10.0),
    ("vincents_area.hard_min_area_fraction", "floor", 0.0, 1.0, 0.005),
    ("blur_laplacian.outlier_z", "cutoff", 0.5, 10.0, 0.25),
    ("blur_tenengrad.outlier_z", "cutoff", 0.5, 10.0, 0.25),
    ("vincents_artefacts.outlier_z", "cutoff", 0.5, 10.0, 0.25),
    ("vincents_motion_blur.outlier_z", "cutoff", 0.5, 10.0, 0.25),
    ("vincents_area.outlier_z", "cutoff", 0.5, 10.0, 0.25),
    ("vincents_artefacts.kernel_size", "param", 1, 40, 1),
    ("blur_laplacian.stroke_width", "param", 1, 40, 1),
    ("blur_tenengrad.stroke_width", "param", 1, 40, 1),
    ("vincents_motion_blur.stroke_width", "param", 1, 40, 1),
    ("vincents_motion_blur.softness", "param", 0.05, 1.0, 0.05),
    ("vincents_area.softness", "param", 0.05, 1.0, 0.05),
)


def _knob(key: str) -> tuple[str, str]:
    """(rule, field of ours) of a knob's key."""
    rule, _, attr = key.partition(".")
    ours = "z" if attr == "outlier_z" else "hard_max" if attr.startswith("hard_max") else "hard_min" if attr.startswith("hard_min") else {"kernel_size": "artifact", "stroke_width": "stroke"}.get(attr, attr)
    return rule, ours


def active_knobs(order: tuple[str, ...]) -> list[tuple[str, str, float, float, float]]:
    """The knobs of filters that the order names."""
    return [k for k in KNOB_TABLE if _knob(k[0])[0] in order]


def set_knobs(cfg: Config, floors: dict | None = None, cutoffs: dict | None = None, params: dict | None = None) -> Config:
    """cfg with knobs set by key: floors and params to a value, cutoffs to {"enabled": bool, "value": float} (off: no tail test).

    Kernel sizes are rounded. Unknown keys are ignored. Bounds are for those who offer knobs; values are taken as they are."""
    known = {k[0] for k in KNOB_TABLE}
    asked: dict[str, dict] = {}
    kernels = cfg.kernels
    for key, value in {**(floors or {}), **{k: (float(v["value"]) if v.get("enabled", True) else None) for k, v in (cutoffs or {}).items()}, **(params or {})}.items():
        if key in known:
            rule, field = _knob(key)
            if field in ("artifact", "stroke"):
                kernels = replace(kernels, **{field: int(round(value))})
            else:
                asked.setdefault(rule, {})[field] = None if value is None else float(value)
    change = lambda r: replace(r, **{k: v for k, v in asked.get(r.name, {}).items() if hasattr(r, k)})
    return replace(cfg, kernels=kernels, rules=tuple(map(change, cfg.rules)), soft=tuple(map(change, cfg.soft)))
