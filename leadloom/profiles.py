"""Organisation profiles: what a deployment may set, checked strictly, and compiled to expressions by the jobs.

A profile is a mapping (a YAML or JSON file). Every section has its own keys; an unknown key or a value of another kind is an error,
which names its place. Keys that are left out keep the values of policy.py; a list or table that is given replaces the default whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from leadloom import policy

CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
SPEND_CLASSES = ("infra-heavy", "neutral", "low-infra")


class ProfileError(ValueError):
    """A profile that cannot be used, with the place of the fault."""


def _kind(kind: type, name: str) -> Callable[[Any, str], Any]:
    def check(value: Any, where: str) -> Any:
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            raise ProfileError(f"{where}: {name} expected, not {value!r}")
        return value

    return check


whole, text, flag = _kind(int, "a whole number"), _kind(str, "a text"), _kind(bool, "true or false")


def listed(item: Callable, some: bool = False) -> Callable[[Any, str], tuple]:
    def check(value: Any, where: str) -> tuple:
        if not isinstance(value, (list, tuple)) or (some and not value):
            raise ProfileError(f"{where}: a list expected, not {value!r}")
        return tuple(item(x, f"{where}[{i}]") for i, x in enumerate(value))

    return check


def table(item: Callable) -> Callable[[Any, str], dict]:
    """A mapping with free keys."""
    return lambda value, where: {str(k): item(v, f"{where}.{k}") for k, v in _kind(dict, "a mapping")(value, where).items()}


def keyed(need: tuple[str, ...] = (), **fields: Callable) -> Callable[[Any, str], dict]:
    """A mapping with these keys alone; need: those that must be there."""

    def check(value: Any, where: str) -> dict:
        given = _kind(dict, "a mapping")(value, where)
        if unknown := sorted(map(str, set(given) - set(fields))):
            raise ProfileError(f"{where}: unknown keys {', '.join(unknown)}")
        if missing := [k for k in need if k not in given]:
            raise ProfileError(f"{where}: {', '.join(missing)} missing")
        return {k: fields[k](v, f"{where}.{k}") for k, v in given.items()}

    return check


def chosen(*allowed: str) -> Callable[[Any, str], str]:
    def check(value: Any, where: str) -> str:
        if text(value, where) not in allowed:
            raise ProfileError(f"{where}: one of {', '.join(allowed)} expected, not {value!r}")
        return value

    return check


def _edge(value: Any, where: str) -> tuple[int, str]:
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise ProfileError(f"{where}: [amount, tier] expected, not {value!r}")
    return whole(value[0], where), text(value[1], where)


SHAPE = keyed(
    name=text, description=text,
    identity=keyed(product_name=text, company_name=text, sender_name=text, sender_email=text, rep_email=text, signature=text), reply=keyed(enabled=flag, draft_on=listed(chosen("clear", "review", "blocked")), subject_prefix=text),
    fit=keyed(
        threshold=whole, sales_ready_min_confidence=chosen(*CONFIDENCES), max_score=whole, confidence=keyed(requires_cloud_signal=flag),
        size_bands=table(keyed(("employees", "min", "max"), employees=whole, min=whole, max=whole)), scale=keyed(unknown=keyed(points=whole, note=text), tiers=listed(keyed(("points",), below=whole, points=whole, note=text), some=True)),
        cloud=keyed(points_cap=whole, state_points=table(whole)), workload_intensity=keyed(points_per_category=whole, cap=whole, categories=table(listed(text))),
        complexity=keyed(points_cap=whole, rules=listed(keyed(("points",), label=text, points=whole, field=chosen("text", "industry"), any=listed(text), all=listed(text)))),
        spend=keyed(usd_per_employee=table(whole), tier_edges=listed(_edge), tier_above=text, high_industries=listed(text), low_industries=listed(text)),
    ),
    compliance=keyed(competitors=listed(text), competitors_file=text, jurisdictions_file=text, competitor_offering=text, generic_name_tokens=listed(text), generic_name_example=text, generic_words_hint=text),
    research=keyed(tech_signal_example=text, tech_signal_guidance=text), notification=keyed(subject_template=text),
)


@dataclass(frozen=True)
class Rule:
    """Points for a text that holds any, and all, of some phrases."""

    field: str
    points: int
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()


@dataclass(frozen=True)
class Fit:
    """The fit section, as the scoring jobs use it."""

    bands: dict[str, tuple[int, int, int]]
    tiers: tuple[tuple[int | None, int], ...]
    unknown_points: int
    state_points: dict[str, int]
    cloud_cap: int
    workloads: dict[str, tuple[str, ...]]
    workload_points: int
    workload_cap: int
    rules: tuple[Rule, ...]
    complexity_cap: int
    high_spend: tuple[str, ...]
    low_spend: tuple[str, ...]
    usd: dict[str, int]
    spend_edges: tuple[tuple[int, str], ...]
    spend_above: str
    max_score: int
    threshold: int
    least_confidence: str
    needs_cloud: bool


def fit_of(profile: dict, name: str = "profile") -> Fit:
    """The fit section of a checked or raw profile, with the defaults of what it leaves out."""
    fit = SHAPE(profile, name).get("fit", {})
    scale, cloud, work, complexity, spend = (fit.get(k, {}) for k in ("scale", "cloud", "workload_intensity", "complexity", "spend"))
    tiers = tuple((t.get("below"), t["points"]) for t in scale["tiers"]) if "tiers" in scale else policy.TIERS
    if tiers[-1][0] is not None or any(below is None for below, _ in tiers[:-1]):
        raise ProfileError(f"{name}.fit.scale.tiers: the last tier, and no other, has no upper end")
    usd = spend.get("usd_per_employee", policy.SPEND_PER_EMPLOYEE)
    if missing := [k for k in SPEND_CLASSES if k not in usd]:
        raise ProfileError(f"{name}.fit.spend.usd_per_employee: {', '.join(missing)} missing")
    default_rules = tuple(Rule(field, policy.COMPLEXITY_POINTS, **{how: words}) for field, how, words in policy.COMPLEXITY)
    return Fit(
        bands={k: (b["employees"], b["min"], b["max"]) for k, b in fit["size_bands"].items()} if "size_bands" in fit else policy.BANDS, tiers=tiers, unknown_points=scale.get("unknown", {}).get("points", policy.UNKNOWN_SCALE_POINTS),
        state_points=policy.STATE_POINTS | cloud.get("state_points", {}), cloud_cap=cloud.get("points_cap", policy.CLOUD_CAP), workloads=work.get("categories", policy.WORKLOADS), workload_points=work.get("points_per_category", policy.WORKLOAD_POINTS),
        workload_cap=work.get("cap", policy.WORKLOAD_CAP), rules=tuple(Rule(r.get("field", "text"), r["points"], r.get("any", ()), r.get("all", ())) for r in complexity["rules"]) if "rules" in complexity else default_rules,
        complexity_cap=complexity.get("points_cap", policy.COMPLEXITY_CAP), high_spend=spend.get("high_industries", policy.HIGH_SPEND), low_spend=spend.get("low_industries", policy.LOW_SPEND), usd=usd,
        spend_edges=spend.get("tier_edges", policy.SPEND_EDGES), spend_above=spend.get("tier_above", policy.SPEND_ABOVE), max_score=fit.get("max_score", policy.MAX_SCORE), threshold=fit.get("threshold", policy.THRESHOLD),
        least_confidence=fit.get("sales_ready_min_confidence", "MEDIUM"), needs_cloud=fit.get("confidence", {}).get("requires_cloud_signal", True),
    )


def parse(source: str) -> dict:
    """A profile from JSON, or from YAML where its library is installed."""
    try:
        given = json.loads(source)
    except ValueError:
        try:
            import yaml
        except ImportError as missing:
            raise ProfileError("this profile is no JSON, and no YAML reader is installed") from missing
        given = yaml.safe_load(source)
    return SHAPE(given or {}, "profile")


def read(spark, path: str) -> dict:
    """A profile file from any store that Spark reads."""
    return parse("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


DEFAULT = fit_of({})
