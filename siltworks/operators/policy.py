"""Options and safety limits of a run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

GIB = 1 << 30


@dataclass(frozen=True)
class Policy:
    layout: str = "hierarchy"
    pdf_only: bool = False
    max_depth: int = 10
    max_members_per_container: int = 100_000
    max_members_run: int = 1_000_000
    max_member_bytes: int = 2 * GIB
    max_container_bytes: int = 20 * GIB
    max_run_bytes: int = 100 * GIB
    max_expansion_ratio: float = 1000.0
    policy_version: int = 1
    detector_version: int = 1

    def validate(self) -> Policy:
        if self.layout not in ("hierarchy", "flatten"):
            raise ValueError("layout is either hierarchy or flatten")
        for key, value in asdict(self).items():
            if key.startswith("max_") and not value > 0:
                raise ValueError(f"{key} has to be positive")
        for less, more in (("max_members_per_container", "max_members_run"), ("max_member_bytes", "max_container_bytes"), ("max_container_bytes", "max_run_bytes")):
            if getattr(self, less) > getattr(self, more):
                raise ValueError(f"{less} is above {more}")
        return self

    def fingerprint(self) -> str:
        text = json.dumps(dict(sorted(asdict(self).items())), separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()
