"""Point-in-time evidence on Spark: bitemporal facts, as-of reads, restatement statistics, panels, backtests, triage."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path


@lru_cache(1)
def code_version() -> str:
    """A stamp of the code that runs: twelve digits of the hash over the engine's sources, the same wherever they lie."""
    root, digest = Path(__file__).parent, hashlib.sha256()
    for path in sorted(root.rglob("*.py"), key=lambda p: p.relative_to(root).as_posix()):
        digest.update(path.relative_to(root).as_posix().encode() + b"\0" + path.read_bytes())
    return digest.hexdigest()[:12]
