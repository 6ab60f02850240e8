"""Language identification by mixture inference.

Training counts letter trigrams, hashed into a fixed number of buckets, for
each language over all training texts; smoothed shares give a table of log
probabilities.  Its size is bounded for any number of languages: the more
there are, the fewer buckets each has.

A document is a mixture: every word (at most 16 letters of it at a time) is
written in one language, with the document's unknown proportions.
Expectation-maximisation estimates the proportions from the words' n-gram
likelihoods.  Which languages take part is chosen by penalised likelihood:
starting from the best single language, a language is added while the log
likelihood rises by more than half the logarithm of the word count, times a
factor.  The prediction is the language with the largest proportion, its
proportion the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is everything when nothing can be learned; very long texts are used whole;
repeated rows agree; equal proportions go to the first name; rows with a null
id or a null language are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_batches, release, slices, stored

BUCKETS = 1 << 16
#: Cells of the table at most; with so many languages that it would have more, buckets are joined in pairs, fours and so on.
MOST_CELLS = 1 << 26
WORD_LETTERS = 16
#: Rounds of expectation-maximisation, and the change of a proportion that ends it.
ROUNDS, SETTLED = 50, 1e-4
#: A language must raise the log likelihood by this many times half log(words).
PENALTY = 4.0
SMOOTHING = 0.1

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, the word that each belongs to, and the text of each word.

    A word is a run of letters, in lower case, between blanks; it has as many
    trigrams as letters.  Long words are cut.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    symbol = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key = symbol[at - 1] << np.uint64(42) | symbol[at] << np.uint64(21) | symbol[at + 1]
    mixed = key * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(48)).astype(np.int64)
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != at[:-1] + 1
    run_start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    begins |= (np.arange(len(at)) - run_start) % WORD_LETTERS == 0
    word = np.cumsum(begins) - 1
    lengths = np.array([len(t) for t in lowered])
    ends = np.cumsum(lengths + 1)
    text = np.searchsorted(ends, at[begins] - 1, side="right")
    return bucket, word, text


def training_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): trigrams of all training texts, added up in each task before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            rows: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.setdefault(lang, []).append(text or "")
            for lang, texts in rows.items():
                if lang not in totals and len(totals) >= 64:
                    yield from _rows(totals)
                    totals = {}
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(word_grams(texts)[0], minlength=BUCKETS)
        yield from _rows(totals)

    def _rows(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Languages:
    """Names, and for each bucket the log probability in each language."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    @classmethod
    def learn(cls, docs: DataFrame) -> Languages:
        """From columns lang and text.  At most MOST_CELLS rows reach the driver, one for each bucket that a language uses."""
        counts, path = stored(training_counts(docs), "langid-counts")
        names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        shift = max(0, (BUCKETS * len(names) - 1).bit_length() - (MOST_CELLS - 1).bit_length())
        joined = counts.groupBy("lang", F.shiftright("bucket", shift).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
        release(docs.sparkSession, path)
        total = np.zeros((BUCKETS >> shift, len(names)))
        column = {n: k for k, n in enumerate(names)}
        total[joined["bucket"].to_numpy(int), joined["lang"].map(column).to_numpy(int)] = joined["n"].to_numpy()
        table = np.log(total + SMOOTHING) - np.log(total.sum(axis=0) + SMOOTHING * len(total)) if names else total
        return cls(names, table.astype(np.float32))

    def infer(self, texts: list[str]) -> tuple[list[str], list[float], list[dict[str, float]]]:
        """Prediction, score and proportions of each text."""
        labels, scores, shares = ["und"] * len(texts), [0.0] * len(texts), [{} for _ in texts]
        if not self.names:
            return labels, scores, shares
        bucket, word, text = word_grams(texts)
        if not len(bucket):
            return labels, scores, shares
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        bucket = bucket >> (BUCKETS // len(self.table)).bit_length() - 1
        likelihood = np.add.reduceat(self.table[bucket], first, axis=0, dtype=np.float64)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            own = likelihood[cut[k] : cut[k + 1]]
            if len(own):
                chosen, weights = mixture(own)
                best = max(range(len(chosen)), key=lambda i: (weights[i], -chosen[i]))
                labels[k], scores[k] = self.names[chosen[best]], float(min(1.0, max(0.0, weights[best])))
                shares[k] = {self.names[c]: float(w) for c, w in zip(chosen, weights)}
        return labels, scores, shares


def proportions(likelihood: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation, and the log likelihood; one row for each word."""
    top = likelihood.max(axis=1, keepdims=True)
    scaled = np.exp(likelihood - top)
    weights = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(ROUNDS):
        joint = scaled * weights
        fresh = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        settled = np.abs(fresh - weights).max() < SETTLED
        weights = fresh
        if settled:
            break
    return weights, float((np.log(scaled @ weights) + top[:, 0]).sum())


def mixture(likelihood: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a document and their proportions, by penalised likelihood."""
    single = likelihood.sum(axis=0)
    chosen, weights = [int(single.argmax())], np.ones(1)
    reached = float(single.max())
    price = PENALTY * 0.5 * np.log(max(2, len(likelihood)))
    # a language that no word prefers by enough cannot pay its price
    gain = np.maximum(likelihood - likelihood[:, chosen], 0).sum(axis=0)
    while len(chosen) < likelihood.shape[1]:
        rest = [k for k in range(likelihood.shape[1]) if k not in chosen and gain[k] > price]
        tried = [(proportions(likelihood[:, chosen + [k]]), k) for k in rest]
        if not tried:
            break
        (w, value), k = max(tried, key=lambda x: (x[0][1], -x[1]))
        if value - reached <= price:
            break
        chosen, weights, reached = chosen + [k], w, value
        gain = np.maximum(likelihood - likelihood[:, chosen].max(axis=1, keepdims=True), 0).sum(axis=0)
    return chosen, weights


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: the checksum of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, languages: Languages, with_shares: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, and the proportions if asked for; only the text is looked at."""
    spark = df.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast((languages.names, languages.table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Languages(*shared.value)
        for batch in slices(batches, "text", 1_000_000):
            labels, scores, shares = known.infer([t or "" for t in batch.column(1).to_pylist()])
            out, names = [batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            if with_shares:
                out.append(pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64())))
                names.append("shares")
            yield pa.RecordBatch.from_arrays(out, names)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", shares map<string,double>" * with_shares)


def learn_and_identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out and have a language, then predict all: doc_id, held_out, lang_pred, score."""
    arrow_batches(df.sparkSession)
    known = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    languages = Languages.learn(known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    return identify(df, languages, id_col=id_col, text_col=text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
