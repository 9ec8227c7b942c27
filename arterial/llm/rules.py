"""Quality rules: ordered decision lists learned by sequential covering.

Statistics of every whole text are computed once for a text (``text_stats``). A bounded
sample of labelled rows is brought to the driver, where rules for the low-quality class
are grown one at a time: conditions ``statistic >= t`` or ``<= t`` are added by
information gain on a growing part, those that a pruning part does as well without are
dropped, and the rows a finished rule covers are taken out. A rule that isn't
precise enough on all rows left ends the search. The list is emitted as one ordered Spark
conditional expression, so applying it is plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the list is learned from, about; all of them where there are fewer.
SAMPLE_ROWS = 12_000
#: Windows of this many words make repeats.
WINDOW = 8
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that conditions may test.
FEATURES = ("n_words", "mean_word_chars", "symbols_pct", "dup_lines_pct", "repeat_pct", "upper_pct", "digit_pct", "bang_pct", "distinct_pct", "top_word_pct", "full_stop_pct")
_MULT = (np.random.default_rng(7).integers(1, 1 << 63, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words (as ids) in windows that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    wide = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += wide[k : k + n] * _MULT[k]
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] >= 2)
    if not len(at):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple:
    """The base statistics and the features of a text; a null text counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: splits at the six ASCII blanks alone
    n = len(words)
    if not n:
        return (0,) * len(BASE_STATS) + (0.0,) * len(FEATURES)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(b"".join(words).decode())
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols = int(bytes_[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(ids)
    upper, lower = int(bytes_[65:91].sum()), int(bytes_[97:123].sum())
    features = (
        float(n), chars / n, 100.0 * symbols / chars, 100.0 * dup_lines / len(lines), 100.0 * repeats / n, 100.0 * upper / max(1, upper + lower),
        100.0 * int(bytes_[48:58].sum()) / chars, 100.0 * int(bytes_[33]) / n, 100.0 * len(number) / n, 100.0 * int(np.bincount(ids).max()) / n,
        100.0 * int(bytes_[46]) / n,
    )
    return (n, chars, symbols, dup_lines, repeats, *features)


_MADE = ", ".join([*(f"{c} long" for c in BASE_STATS), *(f"f_{c} double" for c in FEATURES if c not in BASE_STATS)])


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the base statistics and the features (``f_`` columns;
    the feature n_words is the base column)."""
    names = [*BASE_STATS, *(f"f_{c}" for c in FEATURES if c not in BASE_STATS)]
    kept = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text"), _MADE])
    picks = [*range(len(BASE_STATS)), *(len(BASE_STATS) + k for k, c in enumerate(FEATURES) if c not in BASE_STATS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [text_stats(t) for t in f["text"]]
            made = pd.DataFrame([[r[p] for p in picks] for r in rows], columns=names, index=f.index)
            yield pd.concat([f.drop(columns="text"), made], axis=1)

    return kept.mapInPandas(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def sql(self) -> str:
        name = self.feature if self.feature in BASE_STATS else f"f_{self.feature}"
        return f"{name} {'>=' if self.at_least else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which all conditions hold; counts are those of learning."""

    conditions: tuple[Condition, ...]
    covered: int
    right: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


def _candidates(values: np.ndarray, most: int = 48) -> np.ndarray:
    """Thresholds between neighbouring values, at most so many, at even ranks."""
    v = np.unique(values)
    if len(v) < 2:
        return v[:0]
    mids = (v[1:] + v[:-1]) / 2
    return mids[np.unique(np.linspace(0, len(mids) - 1, most).astype(int))] if len(mids) > most else mids


def _grow(x: dict[str, np.ndarray], y: np.ndarray, thresholds: dict[str, np.ndarray], most: int) -> list[Condition]:
    conditions: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(conditions) < most and (inside & ~y).any():
        p0, n0 = (inside & y).sum(), inside.sum()
        best, gain = None, 1e-9
        for f, cuts in thresholds.items():
            for at_least in (True, False):
                for t in cuts:
                    c = Condition(f, at_least, float(t))
                    now = inside & c.holds(x)
                    p = (now & y).sum()
                    if not p:
                        continue
                    g = p * (np.log2(p / now.sum()) - np.log2(p0 / n0))
                    if g > gain:
                        best, gain = c, g
        if best is None:
            break
        conditions.append(best)
        inside &= best.holds(x)
    return conditions


def _worth(conditions: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    now = Rule(tuple(conditions), 0, 0).holds(x) if conditions else np.ones(len(y), bool)
    p, n = (now & y).sum(), (now & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _prune(conditions: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """Without the conditions, last ones first, that the pruning rows do as well without."""
    for c in reversed(conditions):
        fewer = [d for d in conditions if d is not c]
        if fewer and _worth(fewer, x, y) >= _worth(conditions, x, y):
            conditions = fewer
    return conditions


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_covered: int = 5, max_rules: int = 24, max_conditions: int = 4, seed: int = 11) -> list[Rule]:
    """An ordered list of rules for the rows that are ``bad``. No rules without bad rows."""
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules and (left & bad).any():
        at = rng.permutation(np.flatnonzero(left))
        cut = max(1, len(at) * 2 // 3)
        part = lambda rows: ({f: v[rows] for f, v in x.items()}, bad[rows])
        (gx, gy), (px, py) = part(at[:cut]), part(at[cut:])
        if not gy.any():
            break
        # Thresholds where values of bad rows lie, so that a rare class has its own.
        cuts = {f: np.unique(np.concatenate([_candidates(gx[f], 24), _candidates(gx[f][gy], 24)])) for f in gx}
        conditions = _grow(gx, gy, cuts, max_conditions)
        if not conditions:
            break
        conditions = _prune(conditions, px, py)
        rule = Rule(tuple(conditions), 0, 0)
        now = rule.holds(x) & left
        covered, right = int(now.sum()), int((now & bad).sum())
        if covered < min_covered or right < min_precision * covered:
            break
        rules.append(Rule(rule.conditions, covered, right))
        left &= ~now
    return rules


def conditional_sql(rules: list[Rule]) -> str:
    """The list as an ordered SQL conditional: the number of the first rule that rejects, from 1, else 0."""
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in r.conditions)} THEN {k}" for k, r in enumerate(rules, 1))
    return f"CASE {whens} ELSE 0 END" if rules else "0"


def rejecting_rule(rules: list[Rule]) -> Column:
    return F.expr(conditional_sql(rules)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """About ``most`` labelled documents (doc_id, text, y), chosen by a hash of the id; all where
    there are fewer. A document with several labels counts with the highest; null labels don't count."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    if where is not None:
        own = own.where(where)
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_003)) < int(1_000_003 * most / n))
    # About ``most`` ids and labels, whatever the size of the tables.
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")


def fit_quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> list[Rule]:
    """Rules from the statistics of labelled documents (``quality`` 0 is bad)."""
    sample = labelled_sample(docs, labels.withColumn("__bad", 1 - F.col("quality")), "__bad", sample_rows)
    # In an order of its own, so that rules don't depend on how the tables are laid out.
    seen = with_stats(sample).toPandas()
    seen = seen.sort_values([c for c in seen.columns if c != "doc_id"] + ["doc_id"], kind="stable")
    x = {c: seen[c if c in BASE_STATS else f"f_{c}"].to_numpy(float) for c in FEATURES}
    return learn_rules(x, seen["y"].to_numpy() > 0, **options) if len(seen) else []


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, rule (the first that rejects, 0 for none) and kept.

    A null or empty text has no words and fails the base rule. Equal texts get equal
    verdicts; an empty table gives an empty result. Extra columns of ``docs`` are dropped.
    """
    stats = with_stats(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", rejecting_rule(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select("doc_id", *BASE_STATS, "base_failed", "rule", "kept")
