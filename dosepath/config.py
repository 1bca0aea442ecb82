"""Typed configuration with all problems reported at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

#: Keys that a configuration file must have.
REQUIRED = (
    ("project", "output_dir"),
    ("paths", "omop_dir"),
    ("analysis", "washout_days"),
    ("analysis", "followup_months"),
    ("analysis", "maintenance_min_total_days"),
    ("clustering", "k_grid"),
    ("clustering", "seed"),
)


@dataclass(frozen=True)
class Settings:
    """Parameters of a trajectory run; the defaults are the engine's."""

    washout_days: int = 365
    followup_months: int = 24
    exposure_gap_days: int = 30
    maintenance_min_total_days: int = 56
    maintenance_min_eras: int = 2
    maintenance_single_era_min_days: int = 180
    early_discontinuation_days: int = 90
    restart_window_days: int = 180
    switch_window_days: int = 60
    polypharmacy_threshold: int = 5
    turnover_low: float = 0.20
    turnover_high: float = 0.50
    focus_ingredients: tuple[int, ...] = ()
    stable_turnover_max: float = 0.20
    early_disc_low: float = 0.25
    early_disc_high: float = 0.50
    restart_high: float = 0.50
    switch_high: float = 0.50
    burden_slope_neg: float = -0.10
    k_grid: tuple[int, ...] = (2, 3, 4, 5, 6)
    final_k: int | None = None
    seed: int = 42
    top_ingredients: int = 10
    extra: Mapping[str, Any] = field(default_factory=dict, compare=False)

    def having(self, **changes: Any) -> Settings:
        return replace(self, **changes)


def missing_keys(raw: Mapping[str, Any]) -> list[str]:
    """Required keys that are absent, as section.key."""
    return [".".join(path) for path in REQUIRED if not isinstance(raw.get(path[0]), Mapping) or path[1] not in raw[path[0]]]


def settings_of(raw: Mapping[str, Any], *, strict: bool = True) -> Settings:
    """Settings of a nested mapping; raises ValueError that names every missing key."""
    if strict and (gone := missing_keys(raw)):
        raise ValueError("missing configuration keys: " + ", ".join(gone))
    flat: dict[str, Any] = {**raw.get("analysis", {}), **raw.get("phenotype", {}), **raw.get("clustering", {})}
    renamed = {"focus_ingredient_concept_ids": "focus_ingredients"}
    known = {renamed.get(k, k): v for k, v in flat.items() if renamed.get(k, k) in Settings.__dataclass_fields__ and v is not None}
    for name in ("k_grid", "focus_ingredients"):
        if name in known:
            known[name] = tuple(int(x) for x in known[name])
    run = raw.get("run", {})
    if "save_top_ingredients_per_cluster" in run:
        known["top_ingredients"] = int(run["save_top_ingredients_per_cluster"])
    return Settings(**known, extra=dict(raw))


def load(path: str | Path) -> dict[str, Any]:
    """A configuration file: YAML where a YAML reader is installed, else JSON."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def save(raw: Mapping[str, Any], path: str | Path) -> Path:
    """Write a configuration as JSON, which YAML readers read too; ``load`` gives it back."""
    import json

    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(raw, indent=2) + "\n")
    return out


def output_dir(raw: Mapping[str, Any]) -> Path:
    """The project's output folder, made if absent."""
    out = Path(raw["project"]["output_dir"])
    out.mkdir(parents=True, exist_ok=True)
    return out
