"""A rule's definition and what makes two versions differ."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

# The vocabularies.
DOMAINS = ("SALES", "HCP", "HCO", "PRODUCT", "TERRITORY_ALIGNMENT")
DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "referential_integrity", "timeliness", "conformity")
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
SUBJECT_TYPES = ("record", "batch", "source_period")


class RuleDefinitionError(ValueError):
    """The definition is refused; the message begins with the label of the broken rule, or names the file."""


@dataclass(frozen=True)
class RuleDefinition:
    rule_key: str
    domain: str
    dimension: str
    severity: str
    owning_function: str
    subject_type: str
    predicate_sql: str
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if not re.fullmatch(r"[A-Z][A-Z0-9-]*[A-Z0-9]", self.rule_key) or len(self.rule_key) > 64:
            raise RuleDefinitionError(f"rule_key: {self.rule_key!r} is not upper-case words joined by hyphens")
        for name, allowed in (("domain", DOMAINS), ("dimension", DIMENSIONS), ("severity", SEVERITIES), ("subject_type", SUBJECT_TYPES)):
            if getattr(self, name) not in allowed:
                raise RuleDefinitionError(f"{name}: {getattr(self, name)!r} is not one of {', '.join(allowed)}")
        if not self.predicate_sql.strip():
            raise RuleDefinitionError("predicate_sql: empty")
        if not 0 < len(self.owning_function) <= 120:
            raise RuleDefinitionError("owning_function: 1 to 120 characters")
        for p in self.parameters:
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", p):
                raise RuleDefinitionError(f"parameters: {p!r} is not a name")

    def differs_from(self, severity: str, subject_type: str, predicate_sql: str, parameters: dict) -> bool:
        """Whether this is a new version of a rule stored like that; layout alone makes none."""
        plain = lambda s: " ".join(s.split())
        return (self.severity, self.subject_type, plain(self.predicate_sql), self.parameters) != (severity, subject_type, plain(predicate_sql), parameters)


def load_definition(path: str | Path) -> RuleDefinition:
    """One rule from a YAML or JSON file."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        try:
            import yaml

            raw = yaml.safe_load(text)
        except ImportError:
            raw = json.loads(text)
        if not isinstance(raw, dict):
            raise RuleDefinitionError("a rule is a mapping")
        known = {f.name for f in fields(RuleDefinition)}
        if extra := set(raw) - known:
            raise RuleDefinitionError(f"unknown keys: {', '.join(sorted(extra))}")
        return RuleDefinition(**raw)
    except RuleDefinitionError as e:
        raise RuleDefinitionError(f"{path}: {e}") from e
    except Exception as e:
        raise RuleDefinitionError(f"{path}: {type(e).__name__}: {e}") from e


def load_library(folder: str | Path) -> list[RuleDefinition]:
    rules = [load_definition(p) for p in sorted(Path(folder).iterdir()) if p.suffix in (".yaml", ".yml", ".json")]
    keys = [r.rule_key for r in rules]
    if twice := {k for k in keys if keys.count(k) > 1}:
        raise RuleDefinitionError(f"{folder}: repeated rule keys: {', '.join(sorted(twice))}")
    return rules


def export(rules: list[RuleDefinition], folder: str | Path) -> list[Path]:
    """A JSON file for each rule, which load_library reads back."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for r in rules:
        out.append(Path(folder) / f"{r.rule_key.lower().replace('-', '_')}.json")
        out[-1].write_text(json.dumps({f.name: getattr(r, f.name) for f in fields(r)}, indent=2) + "\n", encoding="utf-8")
    return out
