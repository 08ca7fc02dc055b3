"""Settings and mappings: typed JSON records that are combined, split and overridden on the driver."""

from __future__ import annotations

import json
import re

CASTS = {"int": int, "long": int, "float": float, "double": float, "String": str, "enum_string": str, "settings": lambda v: v}


def cast(kind: str, value):
    """A value of a control's kind."""
    if value is None:
        return None
    if kind == "boolean":
        return value if isinstance(value, bool) else str(value).lower() == "true"
    return CASTS.get(kind, lambda v: v)(value)


class Settings:
    """A record of controls: name, kind, default."""

    def __init__(self, name: str, controls: list[dict]):
        self.name, self.controls = name, controls

    @staticmethod
    def read(text: str) -> Settings:
        """From the JSON of a settings file."""
        spec = json.loads(text)
        return Settings(
            spec.get("name", ""),
            [{"name": c["name"], "kind": c.get("value_type", "String"), "default": c.get("default")} for c in spec.get("controls", [])],
        )

    def combine(self, values: dict | None = None, override: dict | None = None) -> dict:
        """Defaults, then values, then an overriding record; sub-records take the @ prefix."""
        out = {}
        for c in self.controls:
            key = f"@{c['name']}" if c["kind"] == "settings" else c["name"]
            out[key] = c["default"]
            for source in (values or {}, override or {}):
                if key in source or c["name"] in source:
                    out[key] = cast(c["kind"], source.get(key, source.get(c["name"])))
        return out

    def split(self, record: dict) -> dict:
        """One value for each control; defaults for absent ones."""
        return {c["name"]: record.get(f"@{c['name']}" if c["kind"] == "settings" else c["name"], c["default"]) for c in self.controls}

    def names(self, kinds: set[str] | None = None) -> list[str]:
        """Names of the controls of some kinds."""
        return [c["name"] for c in self.controls if kinds is None or c["kind"] in kinds]


def merged(base: dict, new: dict, mode: str = "OVERRIDE") -> dict:
    """ADD_NEW keeps old values, OVERRIDE_ONLY_EXISTING_IN_BOTH adds nothing, OVERRIDE does both."""
    if mode == "ADD_NEW":
        return {**new, **base}
    if mode == "OVERRIDE_ONLY_EXISTING_IN_BOTH":
        return {k: new.get(k, v) for k, v in base.items()}
    return {**base, **new}


def with_sub(record: dict, name: str, sub: dict, mode: str = "SIMPLE", prefix: bool = True) -> dict:
    """A record under a key of another."""
    key = f"@{name}" if prefix else name
    old = record.get(key)
    return {**record, key: sub if mode == "SIMPLE" or old is None else merged(old, sub, mode)}


def sub(record: dict, name: str, mode: str = "OVERRIDE_BY_EXISTING_IN_PARENT", prefix: bool = True) -> dict:
    """The record under a key, with values of its parent by a mode."""
    own = record.get(f"@{name}" if prefix else name) or {}
    parent = {k: v for k, v in record.items() if not k.startswith("@")}
    if mode == "ADD_NEW_TO_PARENT":
        return {**own, **parent}
    if mode == "OVERRIDE_PARENT":
        return {**parent, **own}
    if mode == "OVERRIDE_BY_EXISTING_IN_PARENT":
        return {k: parent.get(k, v) for k, v in own.items()}
    return dict(own)


def mapping_keys(text: str) -> list[tuple[str, str]]:
    """(key, caption) of every line; a range a..b gives all its numbers, $$$ in a caption is the key."""
    out = []
    for line in text.splitlines():
        body, _, caption = line.partition("//")
        body, caption = body.strip(), caption.strip()
        if not body:
            continue
        span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body)
        keys = [str(k) for k in range(int(span[1]), int(span[2]) + 1)] if span else [body]
        out += [(k, caption.replace("$$$", k) or k) for k in keys]
    return out


def mapping_record(text: str, values: dict, default: str | None = None, items: str = "") -> dict:
    """key -> value for every key of a mapping; values beyond the given items (lines) are refused."""
    allowed = {k for k, _ in mapping_keys(items)}
    out = {k: str(values.get(k, default)) if values.get(k, default) is not None else None for k, _ in mapping_keys(text)}
    if allowed and (wrong := sorted({v for v in out.values() if v is not None} - allowed)):
        raise ValueError(f"not among the items: {', '.join(wrong)}")
    return out
