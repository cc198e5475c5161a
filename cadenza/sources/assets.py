"""Model files: which ones a run used, and that they are the ones it asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from cadenza.operators.validate import InvalidData


def identity(folder: str, names: Iterable[str]) -> dict[str, str]:
    """SHA-256 of each named file; recorded with a run's settings."""
    out = {}
    for name in sorted(names):
        digest = hashlib.sha256()
        with Path(folder, name).open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        out[name] = digest.hexdigest()
    return out


def pinned(folder: str, expected: Mapping[str, str], load: Callable[[str], object]) -> Callable[[], object]:
    """A factory for tasks: loads a model from ``folder`` once in a process, after its files' hashes were compared."""
    held: list[object] = []

    def make() -> object:
        if not held:
            have = identity(folder, expected)
            if wrong := [n for n in expected if have[n] != expected[n]]:
                raise InvalidData(f"other model files than asked for: {', '.join(sorted(wrong))}")
            held.append(load(folder))
        return held[0]

    return make
