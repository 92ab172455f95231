"""Configuration: built-in values, a YAML file laid over them, and its validation."""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field

from codestrata.operators import gate, smells
from codestrata.sources import tree

CONFIG_NAME = "codestrata.yaml"


class UsageError(ValueError):
    """A request that cannot be understood."""


@dataclass
class Config:
    version: int = 1
    exclude: list[str] = field(default_factory=lambda: list(tree.EXCLUDED))
    #: Limits and tiers, and weights of the composite.
    budgets: dict[str, dict] = field(
        default_factory=lambda: {
            "avg_complexity": {"limit": 10.0, "tier": "error"},
            "worst_complexity": {"limit": 50.0, "tier": "error"},
            "max_duplication_pct": {"limit": 5.0, "tier": "warn"},
            "max_cycle_members": {"limit": 8.0, "tier": "error"},
            "max_in_cycle_pct": {"limit": 10.0, "tier": "warn"},
        }
    )
    weights: dict[str, float] = field(default_factory=lambda: {"avg_complexity": 25.0, "worst_complexity": 15.0, "max_duplication_pct": 20.0, "max_cycle_members": 20.0, "max_in_cycle_pct": 20.0})
    smells: dict[str, dict] = field(default_factory=dict)
    languages: dict[str, dict] = field(default_factory=dict)
    include_dirs: list[str] = field(default_factory=list)
    folder: str = ""


def canonical(name: str) -> str | None:
    x = name.strip().lower()
    x = tree.ALIASES.get(x, x)
    return x if x in smells.LANGUAGES else None


def load(path: str | None) -> Config:
    """Maps merge by key onto the built-in ones, lists replace them; a missing file leaves all as built in."""
    cfg = Config()
    if not path or not os.path.exists(path):
        return cfg
    try:
        import yaml
    except ImportError as missing:
        raise UsageError("reading a configuration file needs PyYAML") from missing
    with open(path, encoding="utf-8") as source:
        data = yaml.safe_load(source) or {}
    if data.get("version", 1) != 1:
        raise UsageError(f"configuration version {data['version']} is not 1")
    cfg.exclude = list(data.get("exclude", cfg.exclude))
    for name in ("budgets", "smells", "languages"):
        merged = copy.deepcopy(getattr(cfg, name))
        merged.update(data.get(name) or {})
        setattr(cfg, name, merged)
    cfg.weights |= {k: float(v) for k, v in (data.get("weights") or {}).items()}
    for part in ("budgets", "smells"):
        for name, own in (data.get(f"language_{part}") or {}).items():
            cfg.languages.setdefault(name, {}).setdefault(part, {}).update(own or {})
    cfg.folder = os.path.dirname(os.path.abspath(path))
    cfg.include_dirs = [os.path.normpath(os.path.join(cfg.folder, d)) for d in data.get("include_paths") or data.get("include_dirs") or []]
    return cfg


def include_dirs(cfg: Config, root: str) -> list[str]:
    """The include folders below the analysed root, relative to it; others cannot hold an analysed file."""
    below = [os.path.relpath(os.path.join(cfg.folder or ".", d), os.path.abspath(root)).replace(os.sep, "/") for d in cfg.include_dirs]
    return ["" if d == "." else d for d in below if not d.startswith("..")]


def discover(folder: str) -> str | None:
    """The configuration file of the nearest folder upwards."""
    at = os.path.abspath(folder)
    while True:
        if os.path.isfile(os.path.join(at, CONFIG_NAME)):
            return os.path.join(at, CONFIG_NAME)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def validate(cfg: Config) -> None:
    """Unknown metrics, rules, severities and languages are errors."""
    rules = {r[0] for r in smells.CATALOG}
    budgets = list(cfg.budgets)
    groups = [cfg.smells]
    for name, own in cfg.languages.items():
        if canonical(name) is None:
            raise ValueError(f"unknown language {name!r}")
        budgets += list(own.get("budgets") or {})
        groups.append(own.get("smells") or {})
    if bad := gate.unknown([*budgets, *cfg.weights]):
        raise ValueError(f"unknown metric {bad[0]!r}")
    for group in groups:
        for rule, override in group.items():
            if rule not in rules:
                raise ValueError(f"unknown rule {rule!r}")
            if override.get("severity") not in (None, *smells.SEVERITIES):
                raise ValueError(f"unknown severity {override['severity']!r}")


def budget_rows(cfg: Config) -> list[tuple[str, str, float, str]]:
    rows = [("", k, float(b["limit"]), b.get("tier", "")) for k, b in cfg.budgets.items()]
    for name, own in cfg.languages.items():
        rows += [(canonical(name), k, float(b["limit"]), b.get("tier", "")) for k, b in (own.get("budgets") or {}).items()]
    return rows


def override_rows(cfg: Config) -> list[tuple]:
    groups = [(None, cfg.smells), *[(canonical(n), own.get("smells") or {}) for n, own in cfg.languages.items()]]
    return [(rule, lang, o.get("enabled"), None if o.get("threshold") is None else float(o["threshold"]), o.get("severity")) for lang, group in groups for rule, o in group.items()]


TEMPLATE = """# Configuration. Smaller measured values are better; a breach of a budget of tier "error" ends with exit code 1.
version: 1
# Names of directories that are left out; this list replaces the built-in one.
# exclude: [.git, vendor, node_modules]
budgets:
  avg_complexity: {limit: 10, tier: error}
  worst_complexity: {limit: 50, tier: error}
  max_duplication_pct: {limit: 5, tier: warn}
  max_cycle_members: {limit: 8, tier: error}
  max_in_cycle_pct: {limit: 10, tier: warn}
weights:
  avg_complexity: 25
  worst_complexity: 15
  max_duplication_pct: 20
  max_cycle_members: 20
  max_in_cycle_pct: 20
# smells:
#   function-length: {enabled: true, threshold: 60, severity: high}
# language_budgets:
#   python: {avg_complexity: {limit: 8, tier: warn}}
# language_smells:
#   python: {function-length: {threshold: 40}}
# Folders that quoted and angle includes are looked up in, relative to this file.
# include_paths: [include]
"""
