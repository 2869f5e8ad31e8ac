"""Configurations as rules: keys, kinds and ranges."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class ConfigError(ValueError):
    """A malformed configuration; ``problems`` has a line for each key that is wrong."""

    def __init__(self, name: str, problems: list[str]) -> None:
        super().__init__(f"bad_config: {name}: {'; '.join(problems)}")
        self.problems = problems


@dataclass(frozen=True)
class Key:
    """What a key's value must be; ``needed`` keys may not lack."""

    says: str
    holds: Callable[[Any], bool]
    needed: bool = True


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def whole(low: int) -> Key:
    return Key(f"must be an integer >= {low}", lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= low)


def inside(low: float, high: float) -> Key:
    return Key(f"must be in ({low:g}, {high:g})", lambda x: _number(x) and low < x < high)


def above(low: float) -> Key:
    return Key(f"must be > {low:g}", lambda x: _number(x) and x > low)


def at_least(low: float) -> Key:
    return Key(f"must be >= {low:g}", lambda x: _number(x) and x >= low)


def one_of(*values: Any) -> Key:
    return Key(f"must be one of {', '.join(map(str, values))}", lambda x: any(type(x) is type(v) and x == v for v in values))


def text() -> Key:
    return Key("must be a non-empty string", lambda x: isinstance(x, str) and bool(x))


def listed(key: Key, least: int = 1) -> Key:
    return Key(f"must be a list of {least} or more; each {key.says}", lambda x: isinstance(x, list) and len(x) >= least and all(map(key.holds, x)))


def optional(key: Key) -> Key:
    return Key(key.says, key.holds, needed=False)


def check(name: str, config: Any, keys: dict[str, Key], also: Callable[[dict], list[str]] = lambda c: []) -> dict:
    """``config`` as it is, or ``ConfigError`` with all its problems: keys that lack or are unknown, values that break their rule."""
    if not isinstance(config, dict):
        raise ConfigError(name, ["must be a mapping"])
    problems = [f"{k} lacks" for k, rule in keys.items() if rule.needed and k not in config] + [f"{k} is unknown" for k in config if k not in keys]
    problems += [f"{k} {rule.says}, got {config[k]!r}" for k, rule in keys.items() if k in config and not rule.holds(config[k])]
    problems = problems or also(config)
    if problems:
        raise ConfigError(name, problems)
    return config


def _held_out(x: Any) -> bool:
    return isinstance(x, dict) and isinstance(x.get("manifest"), str) and isinstance(x.get("classes"), list) and bool(x["classes"]) and all(isinstance(c, str) for c in x["classes"])


#: The abstention fit's configuration.
ABSTAIN = {
    "k": whole(1),
    "ece_bins": whole(2),
    "coverages": listed(inside(0, 1)),
    "distance_tpr": inside(0, 1),
    "default_coverage": inside(0, 1),
    "epsilon": above(0),
    "n3": Key("must be a list of held-out sources", lambda x: isinstance(x, list) and all(map(_held_out, x))),
}


def abstain_config(config: Any) -> dict:
    return check("abstain", config, ABSTAIN, lambda c: [] if c["default_coverage"] in c["coverages"] else [f"default_coverage {c['default_coverage']!r} is not declared"])
