"""Policies: literals to replace, whose they are, and what must survive."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field

from ..functions.pseudonyms import allocated


class PolicyError(ValueError):
    """A policy that can't be applied; the message holds no value of it."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    value: str
    subject: str | None = None
    case_sensitive: bool = True

    @property
    def identity(self) -> tuple[str, str]:
        return self.kind, self.subject or self.rule_id


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[Rule, ...]
    protected: tuple[str, ...]
    risk: dict = field(default_factory=dict)
    #: pattern -> replacement, as written (exact) and with A-Z lowered (folded)
    exact: dict = field(default_factory=dict)
    folded: dict = field(default_factory=dict)
    replacements: dict = field(default_factory=dict)


def ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def digit_alias(value: str) -> str | None:
    """The digits of a value, if they are seven or more and not all of it."""
    digits = "".join(filter(str.isdigit, value))
    return digits if len(digits) >= 7 and digits != value else None


def _keys(what: str, given: dict, must: set[str], may: set[str] = frozenset()) -> None:
    if not isinstance(given, dict) or not must <= set(given) <= must | may:
        raise PolicyError(f"{what}: keys are missing or unknown")


def _overlap(a: str, b: str) -> bool:
    """One holds the other, or the end of one is the start of the other."""
    return a in b or b in a or any(a.endswith(b[:n]) or b.endswith(a[:n]) for n in range(1, min(len(a), len(b))))


def compiled(payload: dict) -> Policy:
    _keys("policy", payload, {"version", "sensitive_values", "protected_values"}, {"release_risk"})
    if payload["version"] != 1 or isinstance(payload["version"], bool):
        raise PolicyError("the version isn't 1")
    rules: list[Rule] = []
    for x in payload["sensitive_values"]:
        _keys("rule", x, {"rule_id", "type", "value"}, {"subject_id", "match", "case_sensitive"})
        if any(not isinstance(x.get(k, "-"), str) or not x.get(k, "-") for k in ("rule_id", "type", "value", "subject_id")) or x.get("match", "literal") != "literal" or not isinstance(x.get("case_sensitive", True), bool):
            raise PolicyError("a rule's value is empty or of a wrong kind")
        rules.append(Rule(x["rule_id"], x["type"], x["value"], x.get("subject_id"), x.get("case_sensitive", True)))
    if len({r.rule_id for r in rules}) < len(rules):
        raise PolicyError("a rule id is used twice")
    if any(not r.case_sensitive and not r.value.isascii() for r in rules):
        raise PolicyError("only ASCII values can ignore case")
    protected = []
    for x in payload["protected_values"]:
        _keys("protected value", x, {"value"}, {"reason"})
        protected.append(x["value"])
    risk = payload.get("release_risk", {})
    if "release_risk" in payload and (not risk or not set(risk) <= {"max_pseudonym_frequency", "contextual_graph_min_shared_clues"} or any(isinstance(v, bool) or not isinstance(v, int) for v in risk.values()) or risk.get("max_pseudonym_frequency", 1) < 1 or risk.get("contextual_graph_min_shared_clues", 2) < 2):
        raise PolicyError("release_risk is malformed")
    # one spelling, one identity
    owners: dict[str, list[tuple[Rule, bool]]] = {}
    for r in rules:
        alias = digit_alias(r.value)
        for key, is_alias in [(ascii_lower(unicodedata.normalize("NFC", r.value)), False), *([(alias, True)] if alias else [])]:
            for other, other_alias in owners.setdefault(key, []):
                apart = r.case_sensitive and other.case_sensitive and not is_alias and not other_alias and unicodedata.normalize("NFC", r.value) != unicodedata.normalize("NFC", other.value)
                if other.identity != r.identity and not apart:
                    raise PolicyError("two identities share a value")
            owners[key].append((r, is_alias))
    for r in rules:
        for p in protected:
            if _overlap(*((r.value, p) if r.case_sensitive else (ascii_lower(r.value), ascii_lower(p)))):
                raise PolicyError("a protected value overlaps a sensitive one")
    given = allocated((r.identity for r in rules), payload["version"])
    exact: dict[str, str] = {}
    folded: dict[str, str] = {}
    for r in sorted(rules, key=lambda r: r.rule_id):
        forms = {r.value, unicodedata.normalize("NFC", r.value), unicodedata.normalize("NFD", r.value)} | ({digit_alias(r.value)} - {None})
        for f in forms:
            (exact if r.case_sensitive else folded).setdefault(f if r.case_sensitive else ascii_lower(f), given[r.identity])
    return Policy(payload["version"], tuple(rules), tuple(protected), risk, exact, folded, given)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise PolicyError("a key is used twice")
    return dict(pairs)


def load(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return compiled(json.load(f, object_pairs_hook=_unique))
