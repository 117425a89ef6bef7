"""Quality by co-training: one classifier for a text's content and one for its page's metadata.

Both are logistic regressions, fitted on a bounded sample of labelled documents. That of the content weighs surface
figures and a lexical score: hashed words and character trigrams of the whole text, told apart by the means and variances
that each class has of them. Over some rounds each of them labels all
unlabelled documents that it is sure of, and the other one learns from those as well. They stay in Spark: tasks count
them by metadata (which has few distinct values) and sum the gradient and Hessian of the content's classifier. Those of a
class weigh together at most as much as the labelled ones of it, or else the mistakes of one view would outvote all labels,
the more the larger the corpus is. Each is then calibrated on labelled documents that neither has learned from, and the calibrated views are combined: their log odds
over the base rate add up. Every document is scored, in the tasks that read it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import dropped, narrow, packed, small_batches, unpacked, written

LABELLED = 4000  # documents in the labelled sample, at most
TEXT_FEATURES, META_FEATURES = 17, 96  # the last one of the content's is the lexical score
WORD_SLOTS, GRAM_SLOTS = 256, 256
LANGS, SOURCES, LENGTHS = 16, 64, 16  # values of the metadata
ROUNDS, SURE = 4, 0.97  # rounds, least confidence


def text_view(text: str | None) -> np.ndarray:
    """Numbers on a whole text's words and characters."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1.0, counts.sum())
    upper, lower, digits, wide = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum()
    white = counts[9:14].sum() + counts[32]
    marks = size - upper - lower - digits - wide - white
    uses = Counter(words)
    ends = sum(not w[-1].isalnum() for w in words)
    return np.array(
        [
            np.log1p(len(words)),
            len(uses) / n,
            len(uses) / n**0.7,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            max(uses.values(), default=0) / n,
            len(set(zip(words, words[1:], strict=False))) / n,
            upper / max(1.0, upper + lower),
            marks / size,
            np.log1p(100 * marks / size),
            digits / size,
            wide / size,
            (size - white) / n,
            ends / n,
            (counts[33] + counts[35:39].sum() + counts[42] + counts[124]) / size,
            1 - len(set(lines)) / len(lines),
            np.log1p(size / len(lines)),
        ]
    )


def grams(text: str | None) -> bytes:
    """Hashed words, then hashed character trigrams of a whole text: 255 times the root of each slot's share, a byte each."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = np.fromiter((zlib.crc32(w) % WORD_SLOTS for w in raw.split()), np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else b[:0]
    slots = (codes * np.uint32(2654435769)) >> np.uint32(24)
    counts = [np.bincount(words, minlength=WORD_SLOTS), np.bincount(slots, minlength=GRAM_SLOTS)]
    return np.concatenate([np.sqrt(c / max(1, c.sum())) * 255 for c in counts]).round().astype(np.uint8).tobytes()


def _shares(g: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, g)), np.uint8).reshape(len(g), WORD_SLOTS + GRAM_SLOTS) / 255.0


class Lexicon:
    """A linear score of hashed words and trigrams out of both classes' sums: (class, weight | sums | sums of squares)."""

    def __init__(self, sums: np.ndarray):
        n, s, q = sums[:, :1], *np.split(sums[:, 1:], 2, axis=1)
        mean = s / np.maximum(n, 1e-9)
        spread = (q.sum(0) / max(n.sum(), 1e-9) - (n * mean * mean).sum(0) / max(n.sum(), 1e-9)).clip(0) + 1e-4
        self.w, self.middle, self.scale = (mean[0] - mean[1]) / spread, mean.mean(0), 1.0
        apart = float((mean[0] - mean[1]) @ self.w)
        self.scale = max(1e-9, apart / 2)  # the classes' means are at 1 and -1

    @staticmethod
    def sums(shares: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """good, bad: what each row weighs in either class."""
        rows = np.column_stack((np.ones(len(shares)), shares, shares * shares))
        return np.stack((good, bad)) @ rows

    def score(self, shares: np.ndarray) -> np.ndarray:
        return ((shares - self.middle) @ self.w / self.scale).clip(-4, 4)


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed names, and the class of the size that the page states."""
    out = np.zeros(META_FEATURES)
    out[zlib.crc32(f"lang={lang}".encode()) % 16] = 1
    out[16 + zlib.crc32(f"source={source}".encode()) % 64] = 1
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    out[80 + (min(15, int(np.log2(1 + n_chars))) if known else 0)] = 1
    return out


def views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([text_view(t) for t in text]).reshape(-1, TEXT_FEATURES - 1)
    b = np.array([meta_view(*x) for x in zip(lang, source, n_chars, strict=True)]).reshape(-1, META_FEATURES)
    return a, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """L2 logistic regression on standardised features by Newton steps, and a calibration of its log odds."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.line = mean, scale + 1e-6, (1.0, 0.0)
        self.w = np.zeros(len(mean) + 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, more: Callable | None = None, penalty: float = 1.0) -> Logistic:
        """Newton steps from the weights so far; `more` gives the gradient and Hessian of rows that are elsewhere."""
        self.line = (1.0, 0.0)
        self.w = self._newton(self._ready(x), y, penalty, weight, more, self.w)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.line = (1.0, 0.0)
        slope, shift = self._newton(np.column_stack((self.odds(x), np.ones(len(x)))), y, 1.0)
        self.line = (max(slope, 0.0), shift)
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] * (self._ready(x) @ self.w) + self.line[1]

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))))

    @staticmethod
    def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and (negative) Hessian of the weighted log likelihood."""
        p = _sigmoid(x @ w)
        return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x

    @classmethod
    def _newton(cls, x: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray | None = None, more: Callable | None = None, start: np.ndarray | None = None) -> np.ndarray:
        w, ridge = np.zeros(x.shape[1]) if start is None else start, penalty * np.eye(x.shape[1])
        ridge[-1, -1] = 1e-3
        weight = np.ones(len(x)) if weight is None else weight
        for _ in range(25):
            gradient, hessian = cls.sums(x, y, weight, w)
            if more:
                other = more(w)
                gradient, hessian = gradient + other[0], hessian + other[1]
            step = np.linalg.solve(hessian + ridge, gradient - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-5:
                break
        return w


class Content(Logistic):
    """The content's classifier: surface figures and the score of a lexicon, which is renewed in each round."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, lexicon: Lexicon):
        super().__init__(np.append(mean, 0.0), np.append(scale, 1.0))
        self.lexicon = lexicon

    def features(self, df: pd.DataFrame) -> np.ndarray:
        """Of rows (x, g), or (x, score) where the lexical score is known."""
        score = df["score"].to_numpy(float) if "score" in df else self.lexicon.score(_shares(df["g"]))
        return np.column_stack((np.array(df["x"].tolist()).reshape(len(df), -1), score))


def _meta_rows(combos: np.ndarray) -> np.ndarray:
    """The metadata features of the numbers that _combo gives."""
    out, k = np.zeros((len(combos), META_FEATURES)), np.arange(len(combos))
    out[k, combos // (SOURCES * LENGTHS)] = 1
    out[k, LANGS + combos // LENGTHS % SOURCES] = 1
    out[k, LANGS + SOURCES + combos % LENGTHS] = 1
    return out


def _combo(meta: np.ndarray) -> np.ndarray:
    """One number for the metadata features of each row."""
    lang, source, length = meta[:, :LANGS].argmax(1), meta[:, LANGS : LANGS + SOURCES].argmax(1), meta[:, LANGS + SOURCES :].argmax(1)
    return (lang * SOURCES + source) * LENGTHS + length


COMBOS = np.arange(LANGS * SOURCES * LENGTHS)


class Unlabelled:
    """All unlabelled documents (x: surface figures, g: grams, combo: metadata), summed in the tasks that read them.

    `score` is the lexical score of g, written once for each lexicon: the many passes of a fit then read no grams.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.scored: DataFrame | None = None

    def score(self, lexicon: Lexicon) -> None:
        """Put every document's lexical score in place of the one before."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield pd.DataFrame({"x": df["x"], "score": lexicon.score(_shares(df["g"])), "combo": df["combo"]})

        before, self.scored = self.scored, written(self.df.mapInPandas(run, "x array<double>, score double, combo int"), "lexical-scores")
        if before is not None:
            dropped(before)

    def _summed(self, rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
        """The sum over all batches of `of`, an array of a fixed size: a few hundred numbers a task, added up in Spark."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for df in batches:
                if len(df):
                    made = of(df)
                    total = made if total is None else total + made
            if total is not None:
                yield pd.DataFrame({"at": range(len(total)), "s": total})

        made = rows.mapInPandas(run, "at int, s double").groupBy("at").agg(F.sort_array(F.collect_list("s")).alias("s"))  # one order for the sum
        found = made.select("at", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
        return np.array([r["s"] for r in sorted(found)])

    def moments(self) -> np.ndarray:
        """Number, sums and sums of squares of the surface figures."""

        def of(df: pd.DataFrame) -> np.ndarray:
            x = np.array(df["x"].tolist())
            return np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))

        found = self._summed(self.df.select("x"), of)
        return found if len(found) else np.zeros(1 + 2 * (TEXT_FEATURES - 1))

    def counts(self, model: Content | None) -> np.ndarray:
        """Documents by metadata that the content's classifier is sure are good, or bad; of all documents without one."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros((2, len(COMBOS)), np.int64)
            for df in batches:
                if len(df):
                    p = np.ones(len(df)) if model is None else _sigmoid(model.odds(model.features(df)))
                    for k, sure in enumerate((p, 1 - p)):
                        found[k] += np.bincount(df["combo"].to_numpy()[sure >= SURE], minlength=len(COMBOS))
            some = np.flatnonzero(found.any(0))
            yield pd.DataFrame({"combo": some, "good": found[0][some], "bad": found[1][some]})

        out = np.zeros((2, len(COMBOS)))
        made = (self.df.select("combo") if model is None else self.scored).mapInPandas(run, "combo bigint, good bigint, bad bigint").groupBy("combo").agg(F.sum("good"), F.sum("bad"))
        for combo, good, bad in made.collect():  # a row for each metadata value, 16,384 at most
            out[:, combo] = good, bad
        return out

    def lexical_sums(self, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Lexicon.sums over the documents whose metadata has a weight."""

        def of(df: pd.DataFrame) -> np.ndarray:
            combo = df["combo"].to_numpy()
            good = weight[combo] * label[combo]
            return Lexicon.sums(_shares(df["g"]), good, weight[combo] - good).ravel()

        found = self._summed(self.df.select("g", "combo"), of)
        return found.reshape(2, -1) if len(found) else np.zeros((2, 1 + 2 * (WORD_SLOTS + GRAM_SLOTS)))

    def sums(self, model: Content, w: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian over the documents whose metadata has a weight."""

        def of(df: pd.DataFrame) -> np.ndarray:
            df = df[weight[df["combo"].to_numpy()] > 0]
            if not len(df):
                return np.zeros(len(w) * (len(w) + 1))
            combo = df["combo"].to_numpy()
            g, h = Logistic.sums(model._ready(model.features(df)), label[combo], weight[combo], w)
            return np.concatenate((g, h.ravel()))

        made, n = self._summed(self.scored, of), len(w)
        return made[:n], made[n:].reshape(n, n)


def _deviations(n: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums / n
    return mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))


class CoTrained:
    """Both views' calibrated classifiers and the base rate."""

    def __init__(self, sample: pd.DataFrame, y: np.ndarray, free: Unlabelled):
        """sample: (x, g, combo) of the labelled documents; y: whether each is good."""
        self.base = 0.0
        self.models: list[Logistic] = []
        if len(set(y.tolist())) < 2:
            return  # nothing to tell apart: all documents score 1
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.ones(len(y), bool)
        learn = ~held if not held.all() else held
        known, z, pages = sample[learn], y[learn].astype(float), _meta_rows(sample["combo"].to_numpy(int))
        x, meta, shares = np.array(known["x"].tolist()), pages[learn], _shares(known["g"])
        own_sums = Lexicon.sums(shares, z, 1 - z)
        n, s, q = np.split(free.moments(), (1, TEXT_FEATURES))
        content = Content(*_deviations(n[0] + len(x), s + x.sum(0), q + (x * x).sum(0)), Lexicon(own_sums))
        content.fit(content.features(known), z)
        page = Logistic(meta.mean(0), meta.std(0)).fit(meta, z)
        everywhere = free.counts(None)[0]  # documents by metadata
        rows = _meta_rows(COMBOS)
        labelled = np.array([z.sum(), len(z) - z.sum()])

        def calibrated() -> list[Logistic]:
            return [content.calibrate(content.features(sample[held]), y[held]), page.calibrate(pages[held], y[held])]

        self.models = calibrated()
        if n[0]:
            free.score(content.lexicon)
        for _ in range(ROUNDS if n[0] else 0):
            sure = free.counts(content)  # good and bad by content
            p = _sigmoid(page.odds(rows))
            label = np.where(p >= SURE, 1.0, 0.0)
            told = np.array([(p >= SURE) * everywhere, (1 - p >= SURE) * everywhere])  # by metadata
            share = [np.minimum(1, labelled / np.maximum(1, c.sum(1))) for c in (sure, told)]
            weight = np.where(p >= SURE, share[1][0], np.where(1 - p >= SURE, share[1][1], 0.0))

            good, bad = (np.flatnonzero(c) for c in sure)
            t = np.concatenate((z, np.ones(len(good)), np.zeros(len(bad))))
            u = np.concatenate((np.ones(len(z)), share[0][0] * sure[0][good], share[0][1] * sure[1][bad]))
            all_pages = np.vstack((meta, rows[good], rows[bad]))
            page = Logistic(*_deviations(u.sum(), u @ all_pages, u @ (all_pages * all_pages))).fit(all_pages, t, u)
            more = None
            if told.any():
                content.lexicon = Lexicon(own_sums + free.lexical_sums(label, weight))
                free.score(content.lexicon)
                more = lambda w, label=label, weight=weight: free.sums(content, w, label, weight)
            content.fit(content.features(known), z, more=more)
            self.models = calibrated()
        rate = y.mean()
        self.base = float(np.log(rate / (1 - rate)))

    def scores(self, df: pd.DataFrame, meta: np.ndarray) -> np.ndarray:
        """Columns: by content (x, g of df), by metadata, combined."""
        if not self.models:
            return np.ones((len(df), 3))
        content, page = self.models
        odds = content.odds(content.features(df)), page.odds(meta)
        return np.column_stack([_sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0] + odds[1] - self.base)])


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained:
    """Fit on the `labelled` documents with a label whose hashed doc_id is smallest, and on all without one.

    Of rows that share a doc_id, the one with the least features counts.
    """
    small_batches(docs.sparkSession)
    known = narrow(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = narrow(docs, "doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null")

    @F.pandas_udf("struct<x: array<double>, g: binary, combo: int>")
    def both(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        a, b = views(text, lang, source, n_chars)
        return pd.DataFrame({"x": pd.Series(list(a), dtype=object), "g": [grams(t) for t in text], "combo": _combo(b).astype(np.int32)})

    one = texts.select("doc_id", both("text", "lang", "source", "n_chars").alias("v")).groupBy("doc_id").agg(F.min("v").alias("v"))
    made = written(one.join(known, "doc_id", "left").select("doc_id", "v.*", "quality"), "views")
    sample = made.filter("quality is not null").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(labelled).toPandas().sort_values("doc_id", ignore_index=True)
    free = Unlabelled(made.filter("quality is null").select("x", "g", "combo"))
    model = CoTrained(sample, sample["quality"].to_numpy(float) >= 1, free)
    dropped(made, *([free.scored] if free.scored is not None else []))
    return model


def scored(docs: DataFrame, labels: DataFrame, keep: float = 0.5, labelled: int = LABELLED) -> DataFrame:
    """docs with `text_score`, `meta_score`, `score` (the probability of good quality) and `keep` (score >= keep).

    docs: (doc_id, text, lang, source, n_chars and any others, but for those that are added); labels: (doc_id, quality), 1 for good. A document with
    several labels takes the lowest. Null or empty texts and null metadata have features of their own. Without labels
    of both kinds all scores are 1. Rows keep their number; the model doesn't depend on their order. An empty table gives no
    rows; a text of any length counts whole.
    """
    model = fitted(docs, labels, labelled)

    @F.pandas_udf("struct<text_score: double, meta_score: double, score: double>")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        x, meta = views(text, lang, source, n_chars)
        content = pd.DataFrame({"x": list(x), "g": [grams(t) for t in text]})
        return pd.DataFrame(model.scores(content, meta).round(6), columns=["text_score", "meta_score", "score"])

    found = docs.select(packed(docs).alias("row"), score("text", "lang", "source", "n_chars").alias("s"))
    own = ("text_score", "meta_score", "score", "keep")
    return found.select(*unpacked("row", docs.columns, *own), "s.*", (F.col("s.score") >= keep).alias("keep"))
