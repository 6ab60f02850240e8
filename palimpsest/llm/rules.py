"""Quality rules as a short-circuit cascade.

A rule is a predicate on a document that rejects it, with the features that it
needs.  On a sample the order is built step by step: of the rules left, the one
that rejects most per unit of cost among the documents that passed the rules
before it comes next.  A feature costs its time where no rule before has asked
for it, so a rule that shares the word split of an earlier one is cheap.  A
document that one rule rejects is not seen by the rules after it.  The order
changes what is computed, never the verdict: a document is kept if no rule
rejects it.

Words are runs of other characters than space and U+0009 to U+000D.

Defined cases: null and empty texts have no words and are rejected; very long
texts are measured whole; repeated rows are judged alike; null ids are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_batches, slices, texts_of

SYMBOLS = "#*$%&|<>"
#: Rows the order of the rules is estimated on, and their longest text; only the order depends on them.
SAMPLE_ROWS, LONGEST_SAMPLED = 400, 20_000


class Document:
    """Features of a text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at space and U+0009 to U+000D

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        """Words of two bytes or more with an ASCII capital and no ASCII letter in lower case."""
        return sum(w.isupper() and len(w) > 1 for w in self.words)

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        return len(lines) - len(set(lines))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for line in self.text.split("\n") if line.strip(" \t\n\x0b\x0c\r"))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of three that occur twice or more."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if len(number) < 1 << 21:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:
            windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        twin = np.zeros(n - 2, bool)
        equal = ranked[1:] == ranked[:-1]
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twin
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """A name and the test that rejects a document."""

    name: str
    rejects: Callable[[Document], bool]


#: All comparisons are between integers, so any engine gets the same verdicts.
BASE = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeats", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
RULES = BASE + (
    Rule("symbols", lambda d: 100 * d.n_symbols > 30 * d.n_words),
    Rule("duplicate_lines", lambda d: 100 * d.n_dup_lines > 50 * d.n_lines),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words),
    Rule("upper_case", lambda d: 100 * d.n_upper > 30 * d.n_words),
)


def ordered(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per cost among the texts that the rules before them passed; ties in the given order."""
    left, docs, out = list(rules), [Document(t) for t in texts], []
    while left:
        worth = []
        for place, rule in enumerate(left):
            # a trial on copies: what earlier rules have computed is known, what this one computes is not kept
            copies = []
            for doc in docs:
                copy = Document(doc.text)
                copy.__dict__.update(doc.__dict__)
                copies.append(copy)
            began = time.perf_counter()
            rejected = sum(map(rule.rejects, copies))
            worth.append((rejected / max(time.perf_counter() - began, 1e-7), -place))
        rule = left.pop(-max(worth)[1])
        out.append(rule)
        docs = [doc for doc in docs if not rule.rejects(doc)]
    return tuple(out)


def plan(df: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text_col: str = "text") -> tuple[Rule, ...]:
    """The order of the rules, estimated on at most ``rows`` documents, taken from the first parts of the table."""
    sample = df.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") <= LONGEST_SAMPLED).limit(rows).collect()
    return ordered([r["text"] for r in sample], rules)


def first_rejection(doc: Document, rules: tuple[Rule, ...]) -> str | None:
    """The rule that rejects the document first, or None; later rules do not run."""
    return next((r.name for r in rules if r.rejects(doc)), None)


def judge(df: DataFrame, rules: tuple[Rule, ...] | None = None, features: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, kept, and with ``features`` the integers that the base rules use.

    With features every document is measured whole; without, only what the
    cascade needs.
    """
    arrow_batches(df.sparkSession)
    cascade = rules or plan(df, text_col=text_col)
    names = tuple(r.name for r in cascade)
    base = tuple(r.name for r in BASE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                doc = Document(text)
                reason = first_rejection(doc, cascade)
                if features:
                    failed = reason in base or any(r.rejects(doc) for r in BASE if r.name in names)
                    rows.append((doc.n_words, doc.word_chars, doc.n_symbols, doc.n_dup_lines, doc.n_repeat_words, failed, reason is None))
                else:
                    rows.append((reason is None,))
            columns = list(zip(*rows))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 if features else [pa.bool_()]
            labels = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] if features else ["kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *labels])

    columns = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean" if features else "doc_id long, kept boolean"
    return texts_of(df, id_col, text_col).mapInArrow(run, columns)


def keep(df: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    arrow_batches(df.sparkSession)
    cascade = rules or plan(df, text_col=text_col)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        return pa.array([first_rejection(Document(t.as_py()), cascade) is None for t in texts], pa.bool_())

    return df.where(accepted(F.col(text_col).cast("string")))
