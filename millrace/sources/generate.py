"""Seeded data for demonstrations, tests and benches."""

from __future__ import annotations

import json
from collections.abc import Iterator

MASK = (1 << 64) - 1
COUNTRIES = ("CA", "IN", "KE", "NO", "PE", "VN")


def random_numbers(seed: int) -> Iterator[int]:
    """SplitMix64 (Steele, Lea and Flood, 2014)."""
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        yield z ^ (z >> 31)


def _rows(n: int, seed: int) -> Iterator[dict]:
    numbers = random_numbers(seed)
    for i in range(n):
        age, score, country, active = (next(numbers) for _ in range(4))
        yield {"id": i, "name": f"person-{i:05d}", "age": age % 90, "score": round(score % 10_000 / 100, 2), "country": COUNTRIES[country % len(COUNTRIES)], "active": bool(active & 1)}


def generate(shape: str, rows: int = 1000, seed: int = 42, ratio: float = 0.1) -> Iterator[str]:
    """Lines of ``clean``, ``error-heavy`` (short and junk lines), ``mixed`` (odd numbers) or ``jsonl``."""
    numbers = random_numbers(seed ^ 0x5DEECE66D)
    hit = lambda: next(numbers) % 10_000 < ratio * 10_000
    if shape == "jsonl":
        yield from (json.dumps(r, separators=(",", ":")) for r in _rows(rows, seed))
    elif shape == "mixed":
        yield "id,value"
        for r in _rows(rows, seed):
            yield f"{r['id']},{('N/A' if next(numbers) & 1 else str(r['age']) + '.5') if hit() else r['age']}"
    elif shape in ("clean", "error-heavy"):
        yield "id,name,age,score,country,active"
        for r in _rows(rows, seed):
            if shape == "error-heavy" and hit():
                yield f"{r['id']},{r['name']}" if next(numbers) & 1 else "###"
            else:
                yield f"{r['id']},{r['name']},{r['age']},{r['score']:.2f},{r['country']},{str(r['active']).lower()}"
    else:
        raise ValueError(f"unknown shape {shape}")
