"""Rules as data: JSON with comments, merged from several files in order, with a fingerprint."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from factweave.operators.effects import EffectRule


def read_jsonc(text: str) -> dict:
    """JSON that may hold // and /* */ comments and trailing commas; what stands in strings is left alone."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    kept = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept)
    return json.loads(kept) if kept.strip() else {}


@dataclass
class RuleSet:
    """Rule sections by name: lists in the order of the files, and display marks."""

    effects: list[EffectRule] = field(default_factory=list)
    handoffs: list[dict] = field(default_factory=list)
    redirects: list[dict] = field(default_factory=list)
    cuts: list[str] = field(default_factory=list)
    contexts: list[dict] = field(default_factory=list)
    factories: list[dict] = field(default_factory=list)
    deliveries: list[dict] = field(default_factory=list)
    entry_points: list[dict] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)
    marks: dict[str, str] = field(default_factory=dict)

    def merged(self, other: RuleSet) -> RuleSet:
        """Lists one after the other; of two marks for a name the other's."""
        out = RuleSet()
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            setattr(out, f.name, {**a, **b} if isinstance(a, dict) else [*a, *b])
        return out

    def fingerprint(self) -> str:
        """A hash that changes with any rule and with the order of rules."""
        shown = {f.name: [x.__dict__ if isinstance(x, EffectRule) else x for x in v] if isinstance(v := getattr(self, f.name), list) else v for f in fields(self)}
        return hashlib.sha256(json.dumps(shown, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def parse_rules(text: str) -> RuleSet:
    """A rule file's sections; unknown sections are an error, so that a misspelt one is noticed."""
    data = read_jsonc(text)
    known = {f.name for f in fields(RuleSet)}
    if unknown := set(data) - known:
        raise ValueError(f"unknown rule sections: {sorted(unknown)}")
    lists = {k: v for k, v in data.items() if k != "effects"}
    rules = [EffectRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in data.get("effects", [])]
    return RuleSet(effects=rules, **lists)


def load_rules(paths: list[str]) -> RuleSet:
    """Files merged in order, later ones last; files that don't exist are passed over, malformed ones are an error."""
    out = RuleSet()
    for path in paths:
        if Path(path).exists():
            out = out.merged(parse_rules(Path(path).read_text(encoding="utf-8")))
    return out


@dataclass(frozen=True)
class Deployment:
    """A service: the project it starts from and what it provides."""

    service: str
    project: str
    provides: tuple[str, ...] = ()


def parse_deployments(text: str) -> list[Deployment]:
    return [Deployment(d["service"], d["project"], tuple(d.get("provides", ()))) for d in read_jsonc(text).get("services", [])]
