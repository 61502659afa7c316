"""Link configurations: variables, nested comparisons, and the order in which they are worked on."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from kindred.functions.similarity import ALIASES

RENAMED = {"term_freq_adjustment": "tf_adjust", "upper_case": "upper", "stringdist_method": "distmethod", "tol_em": "tol"}
EXACT, NUMERIC = {"exact", "bool"}, {"numeric", "float", "int"}
EM_KEYS = {"p_m", "iter_max", "tol", "prior_lambda", "w_lambda", "prior_pi", "w_pi", "address_field", "threshold_match", "u_b", "seed", "digit_precision"}


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str  # exact, numeric, fuzzy, string, nested
    distance: str = "jarowinkler"
    cut_a: float = 0.92
    cut_b: float = 0.88
    partial: bool = True
    w: float = 0.1
    upper: bool = True
    tf_adjust: bool = False
    tf_adjustment_weight: float = 1.0
    tf_minimum_u_value: float = 0.001

    @property
    def levels(self) -> int:
        return 3 if self.partial and self.kind not in ("exact", "nested") else 2


@dataclass(frozen=True)
class Comparison:
    name: str
    variables: tuple[Variable, ...]
    parent: str | None = None
    depth: int = 0
    em: dict[str, Any] = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        t = self.em.get("threshold_match", 0.85)
        return float(t[0] if isinstance(t, list | tuple) else t)


def variable(spec: dict[str, Any]) -> Variable:
    s = {RENAMED.get(k, k): v for k, v in spec.items()}
    if "varname" not in s or "method" not in s:
        raise ValueError(f"a variable needs varname and method: {spec}")
    method, name = str(s.pop("method")).lower(), s.pop("varname")
    if method in EXACT:
        kind, given = "exact", {}
    elif method in NUMERIC:
        kind, given = "numeric", {"cut_a": 1, "cut_b": 2}
    elif method == "fuzzy":
        kind, given = "fuzzy", {}
    elif method == "string" or method in ALIASES:
        wanted = str(s.pop("distmethod", "jw") if method == "string" else method).lower()
        if wanted not in ALIASES:
            raise ValueError(f"unknown string distance {wanted!r}")
        kind, given = "string", {"distance": ALIASES[wanted]}
    else:
        raise ValueError(f"unknown method {method!r} of variable {name!r}")
    s.pop("distmethod", None)
    known = set(Variable.__dataclass_fields__) - {"name", "kind", "distance"}
    if odd := set(s) - known:
        raise ValueError(f"unknown keys of variable {name!r}: {sorted(odd)}")
    return Variable(name, kind, **(given | s))


def retrieve(spec: Any, key: str) -> list[Any]:
    """All values of a key, outermost first, through nested dictionaries and lists."""
    if isinstance(spec, list | tuple):
        return [v for x in spec for v in retrieve(x, key)]
    if not isinstance(spec, dict):
        return []
    own = [spec[key]] if key in spec else []
    return own + [v for k, x in spec.items() if k != key for v in retrieve(x, key)]


def fetch_parameters(spec: Any, name: str) -> dict[str, Any] | None:
    """The dictionary of the variable `name`."""
    if isinstance(spec, dict):
        if spec.get("varname") == name:
            return spec
        spec = list(spec.values())
    if isinstance(spec, list | tuple):
        return next((f for x in spec if (f := fetch_parameters(x, name)) is not None), None)
    return None


def remove_keys(spec: dict[str, Any], keys: set[str]) -> dict[str, Any]:
    return {k: v for k, v in spec.items() if k not in keys}


def parse(config: dict[str, Any]) -> list[Comparison]:
    """The comparisons of a configuration, deepest first, so that nested ones are decided before they are used; the last is the root."""
    out: list[Comparison] = []

    def walk(spec: dict[str, Any], parent: str | None, depth: int) -> None:
        if "variables" not in spec:
            raise ValueError("comparisons need variables")
        name, own = spec.get("name", "total"), []
        for v in spec["variables"]:
            if "comparisons" in v:
                own.append(Variable(v["comparisons"]["name"], "nested", partial=False))
                walk(v["comparisons"], name, depth + 1)
            else:
                own.append(variable(v))
        em = {RENAMED.get(k, k): v for k, v in remove_keys(spec, {"name", "variables"}).items()}
        if odd := set(em) - EM_KEYS:
            raise ValueError(f"unknown keys of comparisons {name!r}: {sorted(odd)}")
        out.append(Comparison(name, tuple(own), parent, depth, em))

    walk(config.get("comparisons", config), None, 0)
    names = [x.name for x in out]
    used = [v.name for x in out for v in x.variables if v.kind != "nested"]
    for what, seen in (("comparisons", names), ("variables", used)):
        if len(set(seen)) < len(seen):
            raise ValueError(f"names of {what} repeat: {seen}")
    return sorted(out, key=lambda x: -x.depth)


def ids(config: dict[str, Any]) -> tuple[str, str]:
    a, b = config["idvar"]
    return a, b


def load(path: str) -> dict[str, Any]:
    with open(path) as f:
        return json.load(f)
