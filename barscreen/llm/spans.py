"""Found spans of a text as strings and digests, shared by the scanning operators."""

from __future__ import annotations

import bisect
import hashlib
import itertools

import pandas as pd

Span = tuple[str, int, int]  # kind, start, end: code points, end exclusive


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then in the order of kinds, comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


class Cover:
    """Which places of a text spans cover: each question takes the logarithm of their number."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(itertools.accumulate((b for _, b in ordered), max))  # the furthest end so far

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)  # spans that begin before the end
        return before > 0 and self.ends[before - 1] > start


def report(found: list[tuple[list[Span], list[Span]]], base: tuple[str, ...], added: tuple[str, ...]) -> pd.DataFrame:
    """A row for each text's (base spans, added spans): counts by kind, the digest of the base spans, all spans."""
    rows = []
    for own, more in found:
        counts = [sum(s[0] == k for s in [*own, *more]) for k in (*base, *added)]
        rows.append((*counts, hashlib.sha256(joined(own, base).encode()).hexdigest(), joined([*own, *more], (*base, *added))))
    return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in (*base, *added)), "base_sha256", "spans"])


def report_type(base: tuple[str, ...], added: tuple[str, ...]) -> str:
    return f"struct<{', '.join(f'n_{k}: bigint' for k in (*base, *added))}, base_sha256: string, spans: string>"
