"""Settings of a run, from keyword arguments or a TOML file; unknown names and impossible values are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace


SECTIONS = {
    "limits": ("fragment_idle_seconds", "flow_idle_seconds", "max_body_bytes", "max_packet_ids", "max_pending_bytes", "max_pending_segments", "max_flow_bytes", "overlap_bytes"),
    "quality": ("error_ratio", "error_floor"),
    "detection": ("generic_secret_scan", "credit_card_scan", "extra_sensitive_field_names"),
    "output": ("material_policy", "fingerprint_salt"),
}


@dataclass(frozen=True)
class Settings:
    """Bounds that change results, and what is scanned and shown."""

    fragment_idle_seconds: int = 30
    flow_idle_seconds: int = 300
    max_body_bytes: int = 131_072
    max_packet_ids: int = 8_192
    max_pending_bytes: int = 524_288
    max_pending_segments: int = 4_096
    max_flow_bytes: int = 67_108_864
    overlap_bytes: int = 131_072
    error_ratio: float = 0.10
    error_floor: int = 100
    generic_secret_scan: bool = True
    credit_card_scan: bool = True
    extra_sensitive_field_names: tuple[str, ...] = ()
    material_policy: str = "redacted"
    fingerprint_salt: str = ""

    def validated(self) -> Settings:
        for f in fields(self):
            value, kind = getattr(self, f.name), type(f.default)
            if type(value) is not kind:
                raise ValueError(f"{f.name}: {kind.__name__} expected")
            if kind in (int, float) and value <= 0:
                raise ValueError(f"{f.name}: must be above 0")
        if self.fragment_idle_seconds > self.flow_idle_seconds:
            raise ValueError("fragment_idle_seconds: must not exceed flow_idle_seconds")
        if self.error_ratio > 1:
            raise ValueError("error_ratio: must not exceed 1")
        if self.material_policy not in ("redacted", "raw"):
            raise ValueError("material_policy: redacted or raw")
        if not all(isinstance(n, str) and n.strip() for n in self.extra_sensitive_field_names):
            raise ValueError("extra_sensitive_field_names: names expected")
        return self

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, "rb") as stream:
            given = tomllib.load(stream)
        values = {}
        for section, held in given.items():
            if section not in SECTIONS or not isinstance(held, dict):
                raise ValueError(f"unknown section: {section}")
            for name, value in held.items():
                if name not in SECTIONS[section]:
                    raise ValueError(f"unknown setting: {section}.{name}")
                values[name] = tuple(value) if isinstance(value, list) else value
        return replace(cls(), **values).validated()
