"""Quality rules: learned decision lists over counts of whole texts.

Sequential covering grows one conjunction of thresholds after the other on part of the labelled
rows, prunes it on the rest, keeps it if it still holds there, and goes on with the rows that it
does not cover. The list comes out as ordered conditions of one Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import BLANKS, over_text, stored
from haulmark.llm.words import cut_words, joined, mix, window_hashes

REPEAT_WINDOW = 8
#: Bound of the labelled rows that rules are learned from.
SAMPLE_ROWS = 20_000
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_ROWS = 5
CUTS = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_kinds"]


def repeated_words(h: np.ndarray, first: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in that text."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    w = window_hashes(h, width)
    begin = np.flatnonzero(text[: len(w)] == text[width - 1 :][: len(w)])
    key = mix(w[begin] ^ mix(text[begin].astype(np.uint64)))
    _, at, many = np.unique(key, return_inverse=True, return_counts=True)
    hit = begin[many[at] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    cover[: len(h) + 1] += np.bincount(hit, minlength=len(h) + 1) - np.bincount(hit + width, minlength=len(h) + 1)
    return np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=len(n))


def distinct_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    key = np.unique(mix(h ^ mix(text.astype(np.uint64))), return_index=True)[1]
    return np.bincount(text[key], minlength=len(n))


def count_texts(texts: pa.Array) -> dict[str, pa.Array]:
    words = cut_words(texts)
    data, starts = joined(texts)
    h = words.hashes()

    def summed(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts[:-1], dtype=np.int64)

    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True)):
        seen: set[bytes] = set()
        for line in raw[a:b].split(b"\n"):
            if line.strip(BLANKS):
                lines[i] += 1
                dup[i] += line in seen
                seen.add(line)
    out = [
        words.counts, summed(~_BLANK[data] & ((data & 0xC0) != 0x80)), summed(_SYMBOL[data]), dup,
        repeated_words(h, words.first), lines, summed(_UPPER[data]), summed(_MARK[data]), distinct_words(h, words.first),
    ]
    return {name: pa.array(np.asarray(x, np.int64)) for name, x in zip(COUNTS, out, strict=True)}


def ratios() -> dict[str, Column]:
    """What conditions may speak of; a share of nothing is 0."""

    def share(top, bottom):
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "kind_share": share("n_kinds", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.cut if self.at_least else x < self.cut

    def column(self, by_name: dict[str, Column]) -> Column:
        return by_name[self.name] >= self.cut if self.at_least else by_name[self.name] < self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.cut:.4g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x[c.name])
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until no good row is left in the rule."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p0 or not n0:
            break
        before, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])):
                high = v >= cut
                p_high, n_high = int((b & high).sum()), int((~b & high).sum())
                for at_least, p, n in ((True, p_high, n_high), (False, p0 - p_high, n0 - n_high)):
                    if p and (g := p * (np.log2(p / (p + n)) - before)) > gain:
                        best, gain = Condition(name, at_least, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x[best.name])
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Cut conditions off the end while (hits - misses) / (hits + misses) on other rows does not fall."""
    def worth(r: Rule) -> float:
        inside = covered(r, x)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for rejecting; every third row is kept apart for pruning."""
    apart = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []

    def at(mask):
        return {k: v[mask] for k, v in x.items()}, bad[mask]

    while (bad & left & ~apart).sum() >= LEAST_ROWS:
        rule = prune(grow(*at(left & ~apart)), *at(left & apart))
        inside = covered(rule, x) & left
        hits, all_ = (bad & inside & apart).sum(), (inside & apart).sum()
        if not rule or (bad & inside).sum() < LEAST_ROWS or hits < LEAST_PRECISION * max(all_, 1):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the first rule that holds rejects, and what no rule names is kept."""
    by_name, out = ratios(), F
    for rule in rules:
        test = rule[0].column(by_name)
        for c in rule[1:]:
            test = test & c.column(by_name)
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def apply_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Counts of each whole text, ``base_failed`` and ``kept``; and the rules, for reading.

    Rules are learned from at most ``SAMPLE_ROWS`` rows with ``quality`` 0 or 1, taken in the
    order of a hash of doc_id; rows that fail the base rules teach nothing. Null texts have no
    words and fail the base. Without labels, or where no conjunction holds on rows kept apart,
    the list is empty and only the base rejects. Repeated rows are judged alike; an empty table
    gives no rows.
    """
    counts = stored(over_text(docs, count_texts, ", ".join(f"{c} long" for c in COUNTS), ["doc_id"]))
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = clean.orderBy(*order).limit(SAMPLE_ROWS)
    rows = (
        counts.filter(~base_failed()).join(F.broadcast(chosen), "doc_id")
        .orderBy(*order, *COUNTS).select("_label", *[c.alias(k) for k, c in ratios().items()]).toArrow()
    )
    x = {k: rows.column(k).to_numpy() for k in ratios()}
    rules = learn_rules(x, rows.column("_label").to_numpy() == 0) if rows.num_rows else []
    kept = F.when(base_failed(), F.lit(False)).otherwise(verdict(rules))
    return counts.withColumns({"base_failed": base_failed(), "kept": kept}), rules
