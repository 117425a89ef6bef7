"""Secrets in texts: patterns of known forms, and random strings by token efficiency.

A vocabulary trained on ordinary text spends few tokens on ordinary strings and many on random ones. A run of key
characters with fewer than `ratio` characters per token is reported as random, be it of letters only or not, unless it
is a known digest (announced as one, or in a given set), an identifier (a UUID, a number, a date) or part of a span that
a pattern has found. Long words are kept out by the ratio alone.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, small_batches
from barscreen.llm.packing import encoding
from barscreen.llm.spans import Cover, Span, report, report_type

BASE, ADDED = ("assign", "access", "hex"), ("random",)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is long enough is the same leftmost match as [0-9a-f]+
RUN = re.compile(r"(?<!\w)[A-Za-z0-9+/_=-]{16,}(?!\w)")  # not a part of a word with other letters
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"[0-9_/+=-]+")
DIGEST = re.compile(r"(?:sha-?\d{0,3}|md5|blake\w*|digest|checksum|commit|etag|integrity|crc\d*)\W{0,3}$", re.I | re.A)
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
RATIO = 1.9
#: Letters in the case of a word are held to a lower ratio: the vocabulary is mostly English, and long words of other
#: languages come near RATIO, while of random keys of 16 letters and both cases only one in 20,000 looks like that.
PLAIN, PLAIN_SHARE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 0.92
WINDOW = 256  # characters of a long run that are tokenized at once


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def characters_per_token(run: str) -> float:
    parts = [run[k : k + WINDOW] for k in range(0, len(run), WINDOW)]
    return len(run) / sum(len(encoding().encode_ordinary(p)) for p in parts)


def random_spans(text: str, base: list[Span], ratio: float = RATIO, known: frozenset[str] = frozenset()) -> list[Span]:
    found, known_spans = [], Cover(base)
    for m in RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        if run in known or NUMBER.fullmatch(run) or UUID.fullmatch(run) or known_spans.overlaps(start, end):
            continue
        if len(run) in DIGEST_LENGTHS and DIGEST.search(text, max(0, start - 24), start):
            continue
        if characters_per_token(run) < ratio * (PLAIN_SHARE if PLAIN.fullmatch(run) else 1):
            found.append(("random", start, end))
    return found


def scanned(docs: DataFrame, ratio: float = RATIO, known: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of docs (doc_id, text).

    Other columns are ignored. A null text counts as empty; repeated rows stay. Positions are code points, ends
    exclusive. `known` are digests that are never reported as random. A text of any length is scanned whole, and runs of
    over WINDOW characters are tokenized in pieces of that size. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(report_type(BASE, ADDED))
    def scan(text: pd.Series) -> pd.DataFrame:
        found = []
        for t in text:
            base = base_spans(t or "")
            found.append((base, random_spans(t or "", base, ratio, known)))
        return report(found, BASE, ADDED)

    return narrow(docs, "doc_id", "text").select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
