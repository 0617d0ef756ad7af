"""Per-field settings: what is tokenized and how, which index tables a field has, which fields hold boosts or facets."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..plans.errors import InvalidConfig

FEATURES = frozenset("TokensToTextID BoostTextLocality BoostingFieldData Search Filters Facets Select WhyFound Highlight PhraseBoost".split())
GLOBAL = "*GLOBAL*"


@dataclass(frozen=True)
class FieldConfig:
    tokenize: bool = True
    tokenize_on_chars: str | None = None
    do_not_store_text_longer_than: int = 64
    facet: bool = False
    boost: bool = False
    features: frozenset[str] = FEATURES

    def has(self, feature: str) -> bool:
        return feature in self.features


def _features(raw: Mapping[str, Any]) -> frozenset[str]:
    on, off = raw.get("features"), raw.get("disabled_features")
    if on is not None and off is not None:
        raise InvalidConfig("features and disabled_features can't be given together")
    for name in on or off or ():
        if name != "All" and name not in FEATURES:
            raise InvalidConfig(f"unknown feature {name!r}; there are {sorted(FEATURES)}")
    if on is not None:
        return FEATURES if "All" in on else frozenset(on)
    return FEATURES - (FEATURES if off and "All" in off else frozenset(off or ()))


def _field(raw: Mapping[str, Any]) -> FieldConfig:
    text = raw.get("fulltext") or {}
    chars = text.get("tokenize_on_chars")
    boost = raw.get("boost")
    return FieldConfig(
        tokenize=bool(text.get("tokenize", True)),
        tokenize_on_chars="".join(chars) if chars else None,
        do_not_store_text_longer_than=int(text.get("do_not_store_text_longer_than", 64)),
        facet=bool(raw.get("facet", False)),
        boost=bool(boost),
        features=_features(raw),
    )


@dataclass(frozen=True)
class Config:
    fields: dict[str, FieldConfig] = field(default_factory=dict)
    default: FieldConfig = FieldConfig()

    @staticmethod
    def parse(text: str | Mapping[str, Any] | None) -> Config:
        """From TOML, or JSON if the text starts with a brace. Unlisted fields follow ``*GLOBAL*``."""
        if text is None:
            return Config()
        if isinstance(text, str):
            try:
                text = json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
            except ValueError as e:
                raise InvalidConfig(str(e)) from e
        listed = {name: _field(raw) for name, raw in text.items() if isinstance(raw, Mapping)}
        return Config({k: v for k, v in listed.items() if k != GLOBAL}, listed.get(GLOBAL, FieldConfig()))

    def of(self, path: str) -> FieldConfig:
        return self.fields.get(path, self.default)
