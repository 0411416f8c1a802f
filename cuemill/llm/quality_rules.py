"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common as C

#: Rows on which costs and selectivities are estimated. They set the order of the rules, never a verdict.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


class Text:
    """A text and the counts that rules share; each is made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # on the six ASCII white-space bytes

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside five-word windows that the text holds twice or more."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        key, base = ids[:n], len(seen)
        for i in range(1, WINDOW):
            if int(key.max() + 1) * base >= 2**62:
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + ids[i : i + n]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        repeated = np.zeros(n, bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        edges = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edges, np.flatnonzero(repeated), 1)
        np.add.at(edges, np.flatnonzero(repeated) + WINDOW, -1)
        return int((np.cumsum(edges) > 0).sum())

    def count_of(self, letters: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, letters))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _shouting(t: Text) -> bool:
    upper = t.count_of(_UPPER)
    return upper > t.count_of(_LOWER)


RULES = (
    Rule("too_few_words", lambda t: t.n_words < 10),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("shouting", _shouting),
    Rule("exclamations", lambda t: 5 * t.data.count(b"!!") > t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("digits", lambda t: 2 * t.count_of(_DIGITS) > t.word_chars),
    Rule("word_length", lambda t: t.word_chars > 20 * t.n_words),
)


def measure(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of each rule on each text from scratch, and whether it rejects it."""
    seconds, rejects = np.zeros((len(texts), len(rules))), np.zeros((len(texts), len(rules)), bool)
    for i, text in enumerate(texts):
        for j, rule in enumerate(rules):
            began = time.perf_counter()
            rejects[i, j] = rule.rejects(Text(text))
            seconds[i, j] = time.perf_counter() - began
    return seconds, rejects


def order_rules(seconds: np.ndarray, rejects: np.ndarray) -> list[int]:
    """Rule numbers, the most rejections a second first.

    After each choice the rates are taken anew over the sampled texts that the
    chosen rules let pass, so that a rule which only repeats an earlier one
    moves back. Ties, and an empty sample, keep the given order.
    """
    left, alive, order = list(range(seconds.shape[1])), np.ones(len(seconds), bool), []
    while left:
        rate = [rejects[alive, j].sum() / max(seconds[alive, j].sum(), 1e-9) for j in left]
        best = left.pop(int(np.argmax(rate)))
        order.append(best)
        alive &= ~rejects[:, best]
    return order


def plan_cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """The order of RULES for these documents, from about ``sample_rows`` rows drawn by a hash of the id."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = docs.filter(F.pmod(C.doc_hash("cascade", "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("text")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seconds, rejects = measure(list(batch["text"]))
            yield pd.DataFrame({"seconds": list(seconds), "rejects": list(rejects)})

    got = drawn.mapInPandas(task, "seconds array<double>, rejects array<boolean>").collect()
    shape = (len(got), len(RULES))
    return order_rules(np.array([r[0] for r in got], float).reshape(shape), np.array([r[1] for r in got], bool).reshape(shape))


def judge(docs: DataFrame, order: list[int] | None = None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``failed_rule`` for every row.

    The cascade runs the rules in ``order`` (planned on a sample if None) and
    stops at the first that rejects; ``failed_rule`` names it, so it depends on
    the order while ``kept`` does not. A null or blank text has no words and is
    rejected. Repeated rows are judged each; other columns are ignored; an
    empty table gives an empty result.
    """
    order = plan_cascade(docs) if order is None else order

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cascade = [RULES[j] for j in order]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                t = Text(text)
                failed = next((r.name for r in cascade if r.rejects(t)), None)
                base_failed = t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base_failed, failed is None, failed))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(task, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string")


def keep_good(docs: DataFrame, order: list[int] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; only the rules are run, no count beyond them."""
    order = plan_cascade(docs) if order is None else order

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cascade = [RULES[j] for j in order]
        for batch in batches:
            yield batch[[not any(r.rejects(t) for r in cascade) for t in map(Text, batch["text"])]]

    return docs.mapInPandas(task, docs.schema)


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, words[i:i+4] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, (length(text) - length(replace(text, '!!', ''))) / 2 AS bangs
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR up > low OR 5 * bangs > n_words OR 2 * n_dup_lines > n_lines
    OR 2 * digits > word_chars OR word_chars > 20 * n_words) AS kept
FROM b
"""
