"""Personal data: patterns of known forms, and a skip-chain conditional random field.

The field's nodes are a text's tokens with a digit or an at sign. Neighbouring tokens share a chain potential; tokens
whose digits or letters repeat an earlier token of the document share a skip potential with it, however far away (each
occurrence with the one before, so a document has fewer edges than twice its nodes). Loopy sum-product message passing
then gives each token its marginal over the labels: what a pattern has found at one place raises the same token
elsewhere. The weights are fitted here, by gradient ascent of the likelihood (expected counts by the same message
passing), on generated sentences that hold numbers and addresses in many forms, and look-alikes.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, small_batches
from barscreen.llm.spans import Cover, Span, report, report_type

BASE = ("email", "ip", "card", "phone")
ADDED = ("crf_email", "crf_ip", "crf_card", "crf_phone")
LABELS = ("other", *BASE)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a later start in the same digits fails alike
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]\S*")
CUES = (("mail", "e-mail", "email", "contact", "write"), ("ip", "host", "server", "node"), ("card", "visa", "credit", "debit"), ("phone", "tel", "call", "mobile", "fax", "cell"))
SIZES = (0, 1, 4, 7, 10, 12, 14, 20)  # lower ends of the classes of digit counts
SETTLED, CERTAIN = 1e-6, 0.9  # largest move of a message that counts as none; least belief of a label


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens with a digit or an at sign."""
    found, last = [], 0
    for m in MARK.finditer(text):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        found.append((start, m.end()))
        last = m.end()
    return found


def _features(text: str, start: int, end: int, covers: list[Cover]) -> list[float]:
    """covers: of each kind of BASE."""
    token = text[start:end]
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    core = token.strip(".,;:!?\"'<>[]{}")
    numbers = core.split(".")
    size = max(k for k, least in enumerate(SIZES) if digits >= least)
    before = text[max(0, start - 24) : start].lower().split()
    cue = before[-1].strip(".,:;()") if before else ""
    own = [c.overlaps(start, end) for c in covers]
    return [
        1.0,
        *(size == k for k in range(len(SIZES))),
        "@" in core.strip("@"),
        bool(DOMAIN.search(token)),
        len(numbers) == 4 and all(n.isdigit() and len(n) <= 3 for n in numbers),
        len(numbers) == 2 and all(n.isdigit() for n in numbers),
        token.startswith("+"),
        "(" in token and ")" in token,
        bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", core)),
        bool(re.fullmatch(r"(?:\+?[0-9]{1,3}[-.])?\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}", core)),
        bool(re.fullmatch(r"[0-9]{4}([ -]?[0-9]{4}){2,3}[0-9]{0,3}", core)),
        core.isdigit(),
        digits > 0 and letters > 0,
        letters > 2 * digits,
        any(c in core for c in "=/_#$%&*|:\\"),
        13 <= digits <= 19 and luhn("".join(c for c in token if c in "0123456789")),
        *(cue in words for words in CUES),
        *own,
    ]


def _key(token: str) -> str:
    """What makes two tokens similar: seven digits or more, or else all letters and digits."""
    digits = "".join(c for c in token if c in "0123456789")
    return digits[-10:] if len(digits) >= 7 else "".join(c for c in token.lower() if c.isalnum() or c == "@")


def graph(texts: list[str], bases: list[list[Span]]) -> dict:
    """Nodes and edges of the fields of several texts; no edge joins two texts."""
    where, rows, chain, skip, depth = [], [], [], [], []
    reach = [0] * len(texts)
    for n, (text, base) in enumerate(zip(texts, bases, strict=True)):
        seen: dict[str, int] = {}
        covers = [Cover([x for x in base if x[0] == kind]) for kind in BASE]
        for start, end in tokens_of(text):
            k = len(where)
            depth.append(0)
            if where and where[-1][0] == n and start - where[-1][2] <= 2:
                chain.append((k - 1, k))
                depth[k] = depth[k - 1] + 1
            key = _key(text[start:end])
            if len(key) >= 3:
                if key in seen and (not chain or chain[-1] != (seen[key], k)):
                    skip.append((seen[key], k))
                    depth[k] = max(depth[k], depth[seen[key]] + 1)
                seen[key] = k
            reach[n] = max(reach[n], depth[k])
            where.append((n, start, end))
            rows.append(_features(text, start, end, covers))
    ends = np.array([*chain, *skip], np.int64).reshape(-1, 2)
    own = np.array([n for n, _, _ in where], np.int64)[ends[:, 0]] if where else np.zeros(0, np.int64)
    return {"where": where, "x": np.array(rows, float), "edges": ends, "kind": np.repeat([0, 1], [len(chain), len(skip)]), "text": own, "reach": np.array(reach)}


def marginals(g: dict, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of nodes and of edges by loopy message passing until no message moves.

    A damped round carries half of what is known one edge on, so the bound is some times a text's longest path; only loops
    that don't settle come to it. Each text stops by itself: what it is batched with changes nothing.
    """
    score = g["x"] @ node
    phi = np.exp(score - score.max(axis=1, keepdims=True))
    a, b = g["edges"].T
    psi = np.exp(edge)[g["kind"]]
    there, back = np.full((2, len(a), len(LABELS)), 1.0 / len(LABELS))  # messages a to b, and b to a

    def belief() -> np.ndarray:
        logs = np.log(phi + 1e-30)
        np.add.at(logs, b, np.log(there + 1e-30))
        np.add.at(logs, a, np.log(back + 1e-30))
        out = np.exp(logs - logs.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    bound, live, done = 4 * g["reach"][g["text"]] + 100, np.ones(len(a), bool), 0
    while live.any():
        at = belief()
        out = np.einsum("ei,eij->ej", at[a] / (back + 1e-30), psi)
        home = np.einsum("ej,eij->ei", at[b] / (there + 1e-30), psi)
        moved = np.zeros(len(g["reach"]))
        for old, new in ((there, out), (back, home)):
            new = np.where(live[:, None], 0.5 * new / new.sum(axis=1, keepdims=True) + 0.5 * old, old)
            np.maximum.at(moved, g["text"], np.abs(new - old).max(axis=1))
            old[:] = new
        done += 1
        live &= (moved[g["text"]] > SETTLED) & (done < bound)
    at = belief()
    joint = (at[a] / (back + 1e-30))[:, :, None] * psi * (at[b] / (there + 1e-30))[:, None, :]
    return at, joint / joint.sum(axis=(1, 2), keepdims=True)


def _card(r: random.Random) -> str:
    head = "".join(r.choices("0123456789", k=15))
    return next(head + d for d in "0123456789" if luhn(head + d))


def _made(r: random.Random) -> tuple[str, int]:
    """A piece of text with digits or an at sign, and its label."""
    n = lambda k: "".join(r.choices("0123456789", k=k))
    w = lambda k: "".join(r.choices("etaoinshrdlu", k=k))
    part = lambda: str(r.randint(0, 255))
    forms = (
        (lambda: f"{w(5)}.{n(2)}@{w(4)}{n(1)}.example.com", 1), (lambda: f"{w(6)}@{w(5)}.org", 1), (lambda: f"{w(6)}@localhost", 1), (lambda: f"<{w(4)}_{n(2)}@{w(5)}>", 1),
        (lambda: ".".join(part() for _ in range(4)), 2), (lambda: ".".join(part() for _ in range(4)) + ":8080", 2),
        (lambda: _card(r), 3), (lambda: (c := _card(r))[:4] + "-" + c[4:8] + "-" + c[8:12] + "-" + c[12:], 3), (lambda: " ".join(re.findall("....", _card(r))), 3),
        (lambda: f"+{r.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}", 4), (lambda: f"({n(3)}) {n(3)}-{n(4)}", 4), (lambda: f"{n(3)}-{n(3)}-{n(4)}", 4), (lambda: f"+{n(11)}", 4), (lambda: f"+{n(2)}.{n(3)}.{n(3)}.{n(4)}", 4),
        (lambda: n(r.randint(1, 6)), 0), (lambda: f"{n(1)}.{n(1)}", 0), (lambda: f"{n(1)}.{n(2)}.{n(1)}", 0), (lambda: f"{n(4)}-{n(2)}-{n(2)}", 0), (lambda: f"${n(3)}.{n(2)}", 0), (lambda: n(r.randint(7, 13)), 0),
        (lambda: n(r.randint(20, 40)), 0), (lambda: next(x for x in iter(lambda: n(r.randint(13, 19)), "") if not luhn(x)), 0), (lambda: "".join(r.choices("0123456789abcdef", k=r.choice((18, 32, 40)))), 0), (lambda: "password=" + "".join(r.choices("0123456789abcdef", k=18)), 0), (lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJ234567", k=16)), 0),
        (lambda: f"{w(4)}{n(2)}", 0), (lambda: f"@{w(6)}", 0), (lambda: f"{n(2)}%", 0), (lambda: f"#{n(3)}", 0), (lambda: f"{n(2)}:{n(2)}", 0), (lambda: f"{n(4)}/{n(2)}", 0), (lambda: f"{w(3)}@", 0), (lambda: "@", 0),
    )
    make, label = r.choice(forms)
    return make(), label


def _sentences(count: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts, and for each (start, end, label) of its pieces."""
    r, texts, labels = random.Random(seed), [], []
    for _ in range(count):
        text, own, kept = "", [], []
        for _ in range(r.randint(3, 8)):
            text += " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 8))) for _ in range(r.randint(1, 5))) + " "
            piece, label = r.choice(kept) if kept and r.random() < 0.3 else _made(r)
            kept.append((piece, label))
            if r.random() < 0.3:
                text += (r.choice(CUES[label - 1]) if label else r.choice(("version", "in", "price", "id"))) + r.choice((" ", ": "))
            own.append((len(text), len(text) + len(piece), label))
            text += piece + r.choice((" ", ". ", ", ", "\n"))
        texts.append(text)
        labels.append(own)
    return texts, labels


@functools.cache
def fitted(count: int = 400, steps: int = 150, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of nodes (feature, label) and of edges (chain or skip, label, label), of a fixed size."""
    texts, labels = _sentences(count, seed)
    r = random.Random(seed + 1)
    bases = [[s for s in base_spans(t) if r.random() < 0.7] for t in texts]  # or else the patterns would explain all
    g = graph(texts, bases)
    truth = np.array([next((label for a, b, label in labels[n] if a < end and start < b), 0) for n, start, end in g["where"]])
    wanted = np.eye(len(LABELS))[truth]
    a, b = g["edges"].T
    node, edge = np.zeros((g["x"].shape[1], len(LABELS))), np.zeros((2, len(LABELS), len(LABELS)))
    seen = np.zeros_like(edge)
    np.add.at(seen, (g["kind"], truth[a], truth[b]), 1.0)
    rate = lambda k: 8.0 / (1 + k / 50)
    for k in range(steps):
        at, joint = marginals(g, node, edge)
        expected = np.zeros_like(edge)
        np.add.at(expected, g["kind"], joint)
        node += rate(k) * (g["x"].T @ (wanted - at) / len(at) - 1e-4 * node)
        edge += rate(k) * ((seen - expected) / len(at) - 1e-4 * edge)
    return node, edge


def field_spans(texts: list[str], bases: list[list[Span]], weights: tuple[np.ndarray, np.ndarray]) -> list[list[Span]]:
    """The spans that the field adds to those of the patterns."""
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, bases)
    if not g["where"]:
        return out
    at, _ = marginals(g, *weights)
    label = np.where(at.max(axis=1) >= CERTAIN, at.argmax(axis=1), 0)
    last, covers = None, [Cover(x) for x in bases]
    for (n, start, end), k in zip(g["where"], label.tolist(), strict=True):
        text = texts[n]
        while end > start and text[end - 1] in ".,;:!?\"'>]})":
            end -= 1
        while start < end and text[start] in "\"'<[{":
            start += 1
        if not k or start == end or covers[n].overlaps(start, end):
            last = None
            continue
        if last and last[:2] == (n, k) and start - out[n][-1][2] <= 2:
            out[n][-1] = (ADDED[k - 1], out[n][-1][1], end)
        else:
            out[n].append((ADDED[k - 1], start, end))
        last = (n, k)
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email .. n_phone, n_crf_email .. n_crf_phone, base_sha256, spans) for every row of docs (doc_id, text).

    Other columns are ignored. A null text counts as empty; repeated rows stay. Positions are code points, ends
    exclusive. The field adds spans that overlap none of the patterns' spans and never takes one away: tokens that look like
    a kind, stand after its words, or are like other tokens of it in the text; a check digit is one of the marks of a card.
    A text of any length is one field. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    weights = fitted()

    @F.pandas_udf(report_type(BASE, ADDED))
    def scan(text: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in text]
        bases = [base_spans(t) for t in texts]
        return report(list(zip(bases, field_spans(texts, bases, weights), strict=True)), BASE, ADDED)

    return narrow(docs, "doc_id", "text").select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
