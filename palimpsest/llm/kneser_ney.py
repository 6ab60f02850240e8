"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

Grams are of characters.  A symbol has 16 bits (digits count as one, white
space as one, and code points beyond the first plane share a range), so a gram
of four symbols is one 64-bit number; its context is the number without the
last symbol, its suffix the number without the first.

The model is fitted on the whole texts of all trusted documents.  A bit table
of bounded size passes over most documents without a trusted id; the texts that
are left are joined with the ids by a shuffle, at every size of the corpus, so
no list of ids is broadcast.  Raw counts serve the highest order, lower orders count the distinct symbols before a gram.  For each
language and order three discounts follow from the counts of counts.  All
tables are sharded by gram or context and joined; the probabilities are stored
as one folder for each language and shard.  Scoring cuts documents into blocks,
looks the distinct grams of a block up in one shard after the other, and keeps
a bounded number of shards at hand, so memory does not depend on the model.
Where the model is larger than that, several blocks are looked up together, so
that it is read less often.  The names of the languages, and nothing else whose
size follows the corpus, are collected and broadcast.

A document is kept if its perplexity is at most its language's threshold: an
exact quantile over the trusted documents of that language, each scored by a model
without its own fold.  Equal texts share a fold.  A language with few of these
scores takes the quantile of their ratios to their language's geometric mean,
pooled over the languages that have enough (over all where none has), times
its own geometric mean.

Defined cases: a null or empty text has a null perplexity and is not kept; a
document whose language has no trusted text (or no language) has a null
perplexity and is kept; one whose language has trusted text in a single fold
has a null threshold and is kept; repeated rows score alike; other columns are
ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Tables, arrow_batches, filesystem, id_marks, kept, marked, release, slices, stored, workspace, written

ORDER = 4
#: Symbols without a character: the start of a text, and the first of those for other planes.
START, BEYOND = 0xD800, 0xD801
#: Rows of a shard, and bytes of shards that a Python process keeps.
SHARD_ROWS, KEPT_BYTES = 40_000, 60_000_000
#: Bytes of text in a block, and in blocks that are looked up together where a model exceeds KEPT_BYTES.
BLOCK_BYTES, TOGETHER_BYTES = 2_000_000, 16_000_000
#: Quantile of the trusted documents, and how many of them a language needs for one of its own.
QUANTILE, ENOUGH = 0.99, 100
#: Cells of a unit of the logarithm, in which a quantile is looked for.
CELLS = 1000
#: Parts of the trusted documents, by text; each is scored by a model of the others.
FOLDS = 5
#: First character of the name of a model of all folds; a model without one fold has that fold's digit.
WHOLE = "*"

_table: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """Symbol of each code point; digits become 0, white space becomes a space."""
    global _table
    if _table is None:
        codes = np.arange(0x110000, dtype=np.uint32)
        table = np.where(codes < 0x10000, codes, BEYOND + codes % 2000).astype(np.uint16)
        table[[c for c in range(0x3000 + 1) if chr(c).isspace()]] = 32
        table[[c for c in range(0x10000) if chr(c).isdecimal()]] = 48
        table[0xD800:0xE000] = BEYOND  # no text holds these
        _table = table
    return _table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts, and how many each text has."""
    pad = "\x00" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = _symbols()[codes].astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    first = np.cumsum(lengths) - lengths + (ORDER - 1) * np.arange(len(texts))
    real = np.ones(len(symbol), bool)
    for k in range(ORDER - 1):
        symbol[first + k] = START
        real[first + k] = False
    # runs of white space are one symbol
    repeat = np.zeros(len(symbol), bool)
    repeat[1:] = (symbol[1:] == 32) & (symbol[:-1] == 32)
    ends = np.append(first[1:], len(symbol))
    kept = np.cumsum(real & ~repeat)
    counts = kept[ends - 1] - np.where(first > 0, kept[first - 1], 0)
    symbol, real = symbol[~repeat], real[~repeat]
    key = np.zeros(len(symbol), np.uint64)
    for k in range(ORDER):
        key[ORDER - 1 :] |= symbol[ORDER - 1 - k : len(symbol) - k] << np.uint64(16 * k)
    return key[real], counts


def _named(df: DataFrame, id_col: str | None, text_col: str, lang_col: str) -> DataFrame:
    ids = [F.col(id_col).cast("long").alias("doc_id")] if id_col else []
    return df.select(*ids, F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, gram, n) for each model, added up in each block before the shuffle; ``lang`` is the name of the model."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for lang, _, texts in _by_language(batch):
                found, n = np.unique(grams(texts)[0], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    parts = trusted.select(_name(F.col("fold"), F.col("lang")).alias("lang"), "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a part belongs to the model of all folds, and to those without another fold
    tags = F.array(F.lit(WHOLE), *[F.lit(str(k)) for k in range(FOLDS)])
    models = parts.select(F.explode(F.filter(tags, lambda tag: tag != F.col("lang").substr(1, 1))).alias("tag"), _language(F.col("lang")).alias("lang"), "gram", "n")
    return models.groupBy(_name(F.col("tag"), F.col("lang")).alias("lang"), "gram").agg(F.sum("n").alias("n"))


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("string")


def _name(tag: Column, lang: Column) -> Column:
    """Name of the model of a language, all folds or without one."""
    return F.concat(tag, lang)


def _language(name: Column) -> Column:
    return name.substr(F.lit(2), F.length(name))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[str]]]:
    """Rows and texts of a batch, language by language."""
    rows: dict[str, list[int]] = {}
    for k, lang in enumerate(batch.column(batch.schema.get_field_index("lang")).to_pylist()):
        rows.setdefault(lang, []).append(k)
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    for lang, own in rows.items():
        yield lang, own, [texts[k] or "" for k in own]


def _discounts(counts: DataFrame) -> DataFrame:
    """Three discounts for each language, from how many grams occur one to four times."""
    n = [F.count_if(F.col("n") == k).cast("double") for k in range(1, 5)]
    seen = counts.groupBy("lang").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    out = []
    for k in (1, 2, 3):
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0))
        # where the counts of counts are too thin, half a count for each step
        fits = (F.col(f"n{k}") > 0) & (value > 0) & (value <= k)
        out.append(F.when(fits, value).otherwise(F.lit(k / 2)).alias(f"d{k}"))
    return seen.select("lang", *out)


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _suffix(gram: Column, order: int) -> Column:
    """The gram of the next lower order."""
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def fit(trusted: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, order, gram, logp) and (lang, order, gram, logb): probabilities, and weights of backing off from a context; ``lang`` is the name of the model.

    They read what is stored in ``tables``.
    """
    counts = {ORDER: tables.store(gram_counts(trusted), "counts")}
    for order in range(ORDER - 1, 0, -1):
        above = counts[order + 1]
        lower = above.groupBy("lang", _suffix(F.col("gram"), order + 1).alias("gram")).agg(F.count("*").alias("n"))
        counts[order] = tables.store(lower, f"counts-{order}")
    probabilities, weights, below = [], [], None
    for order in range(1, ORDER + 1):
        table = counts[order]
        # one row for each language
        cut = F.broadcast(tables.store(_discounts(table), "discounts"))
        known = table.join(cut, "lang").withColumn("context", _context(F.col("gram")) if order > 1 else F.lit(0).cast("long"))
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        known = known.withColumn("cut", F.least(discount, F.col("n").cast("double")))
        contexts = tables.store(known.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare"), F.count("*").alias("types")), f"contexts-{order}")
        joined = known.select("lang", "gram", "context", (F.col("n") - F.col("cut")).alias("rest")).join(contexts, ["lang", "context"])
        weight = F.col("spare") / F.col("total")
        if below is None:
            p = F.col("rest") / F.col("total") + weight / (F.col("types") + 1)
        else:
            joined = joined.withColumn("suffix", _suffix(F.col("gram"), order)).join(below, ["lang", "suffix"])
            p = F.col("rest") / F.col("total") + weight * F.col("p")
        table = tables.store(joined.select("lang", "gram", p.alias("p")), f"probabilities-{order}")
        below = table.select("lang", F.col("gram").alias("suffix"), "p")
        probabilities.append(table.select("lang", F.lit(order).alias("order"), "gram", F.log("p").cast("float").alias("value")))
        if order > 1:
            weights.append(contexts.select("lang", F.lit(order - 1).alias("order"), F.col("context").alias("gram"), F.log(weight).cast("float").alias("value")))
        else:
            # a symbol never seen: the share of the uniform distribution
            weights.append(contexts.select("lang", F.lit(0).alias("order"), F.lit(0).cast("long").alias("gram"), F.log(weight / (F.col("types") + 1)).cast("float").alias("value")))

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        return out

    return union(probabilities), union(weights)


def _odd_prime(least: int) -> int:
    n = max(3, least | 1)
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


class Model:
    """Where a fitted model is stored: one folder for each language and shard."""

    def __init__(self, path: str, languages: dict[str, int], shards: int, rows: int):
        self.path, self.languages, self.shards = path, languages, shards
        #: Bytes of text that are looked up together; a row has a gram and a value.
        self.together = BLOCK_BYTES if 12 * rows <= KEPT_BYTES else TOGETHER_BYTES


def store(trusted: DataFrame) -> Model:
    """Fit and write the models of rows (lang, text, fold).  The names of the languages reach the driver."""
    spark = trusted.sparkSession
    tables = Tables(spark, "kn")
    probabilities, weights = fit(trusted, tables)
    rows, rows_path = stored(probabilities.withColumn("kind", F.lit(0)).unionByName(weights.withColumn("kind", F.lit(1))), "kn-rows")
    tables.release()
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = {lang: k for k, lang in enumerate(sorted(sizes))}
    shards = _odd_prime(-(-max(sizes.values(), default=0) // SHARD_ROWS) + 15)
    path = workspace(spark, "kn-model")
    names = spark.createDataFrame(list(languages.items()), "lang string, language int")
    placed = rows.join(F.broadcast(names), "lang").withColumn("shard", F.pmod("gram", F.lit(shards)).cast("int"))
    # cells (kind, order) and grams rise in each shard
    placed = placed.withColumn("cell", (F.col("kind") * (ORDER + 1) + F.col("order")).cast("int")).select("language", "shard", "cell", "gram", "value")
    placed.repartition("language", "shard").sortWithinPartitions("language", "shard", "cell", "gram").write.partitionBy("language", "shard").parquet(path)
    release(spark, rows_path)
    return Model(path, languages, shards, sum(sizes.values()))


class Shards:
    """Shards of a model in one Python process, the latest used within a number of bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.system, self.top = filesystem(model.path)
        self.kept: OrderedDict[tuple[int, int], dict] = OrderedDict()
        self.size = 0

    def _load(self, language: int, shard: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        at = (language, shard)
        if at in self.kept:
            self.kept.move_to_end(at)
            return self.kept[at]
        folder = f"{self.top}/language={language}/shard={shard}"
        files = [f.path for f in self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
        parts = [pq.ParquetFile(f, filesystem=self.system).read(columns=["cell", "gram", "value"]) for f in files]
        cells: dict = {}
        if parts:
            table = pa.concat_tables(parts)
            cell, gram, value = (table[c].to_numpy() for c in ("cell", "gram", "value"))
            for c in np.unique(cell).tolist():
                own = cell == c
                order = np.argsort(gram[own])
                cells[c] = gram[own][order], value[own][order]
        self.kept[at] = cells
        self.size += sum(g.nbytes + v.nbytes for g, v in cells.values())
        while self.size > KEPT_BYTES and len(self.kept) > 1:
            _, old = self.kept.popitem(last=False)
            self.size -= sum(g.nbytes + v.nbytes for g, v in old.values())
        return cells

    def find(self, language: int, wanted: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Values of grams, for several cells at once; NaN where a gram is not in the model.  Each shard is visited once."""
        out = [np.full(len(keys), np.nan, np.float32) for _, keys in wanted]
        places = []
        for _, keys in wanted:
            shard = (keys.view(np.int64) % self.model.shards).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            places.append((order, np.searchsorted(shard[order], np.arange(self.model.shards + 1))))
        for shard in range(self.model.shards):
            if not any(cut[shard] < cut[shard + 1] for _, cut in places):
                continue
            cells = self._load(language, shard)
            for (cell, keys), (order, cut), values in zip(wanted, places, out):
                own = order[cut[shard] : cut[shard + 1]]
                if cell in cells and len(own):
                    grams_, value = cells[cell]
                    asked = keys[own].view(np.int64)
                    at = np.minimum(np.searchsorted(grams_, asked), len(grams_) - 1)
                    hit = grams_[at] == asked
                    values[own[hit]] = value[at[hit]]
        return out

    def log_probabilities(self, language: int, distinct: np.ndarray) -> np.ndarray:
        """Natural logarithm of the last symbol's probability after the others, for distinct grams."""
        masks = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]
        suffixes = {k: (distinct & masks[k] if k < ORDER else distinct) for k in range(1, ORDER + 1)}
        contexts = {k: suffixes[k + 1] >> np.uint64(16) for k in range(1, ORDER)}
        wanted = [(k, suffixes[k]) for k in range(1, ORDER + 1)]
        wanted += [(ORDER + 1 + k, contexts[k]) for k in range(1, ORDER)]
        wanted.append((ORDER + 1, np.zeros(1, np.uint64)))
        found = self.find(language, wanted)
        unknown = found[-1][0]
        total = np.where(np.isnan(found[0]), unknown, found[0])
        for k in range(2, ORDER + 1):
            weight = np.nan_to_num(found[ORDER + k - 2], nan=0.0)
            total = np.where(np.isnan(found[k - 1]), weight + total, found[k - 1])
        return total


def perplexities(model: Model, blocks: list[tuple[list[str], list[str | None]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block of names of models and texts: grams of each text, and its perplexity; NaN without a model or a gram.

    The distinct grams of all blocks are looked up together.
    """
    shards = kept(("shards", model.path), lambda: Shards(model))
    out, parts = [], {}
    for langs, texts in blocks:
        n_grams, perplexity = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        out.append((n_grams, perplexity))
        rows: dict[str, list[int]] = {}
        for k, lang in enumerate(langs):
            rows.setdefault(lang, []).append(k)
        for lang, own in rows.items():
            keys, counts = grams([texts[k] or "" for k in own])
            n_grams[own] = counts
            language = model.languages.get(lang)
            if language is None or not len(keys):
                continue
            distinct, place = np.unique(keys, return_inverse=True)
            parts.setdefault(language, []).append((perplexity, own, counts, distinct, place.astype(np.uint32)))
    for language, own_parts in parts.items():
        known = own_parts[0][3] if len(own_parts) == 1 else np.unique(np.concatenate([p[3] for p in own_parts]))
        values = shards.log_probabilities(language, known)
        for perplexity, own, counts, distinct, place in own_parts:
            each = values[np.searchsorted(known, distinct)][place].astype(np.float64)
            ends = np.cumsum(each)[np.cumsum(counts) - 1]
            sums = np.diff(np.where(np.cumsum(counts) > 0, ends, 0.0), prepend=0.0)
            perplexity[own] = np.where(counts > 0, np.exp(-sums / np.maximum(counts, 1)), np.nan)
    return out


def _together(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[list[pa.RecordBatch]]:
    """Blocks that are looked up together."""
    group, size = [], 0
    for batch in slices(batches, "text", BLOCK_BYTES):
        own = pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
        if group and size + own > model.together:
            yield group
            group, size = [], 0
        group.append(batch)
        size += own
    if group:
        yield group


def _scored(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """Each block with the grams and perplexities of its columns ``lang`` and ``text``."""
    for group in _together(batches, model):
        found = perplexities(model, [(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) for batch in group])
        for batch, (n_grams, perplexity) in zip(group, found):
            yield batch, pa.array(n_grams), pa.array(perplexity, from_pandas=True)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity) of every row; ``lang`` is the name of the model that scores it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_grams, perplexity in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_grams, perplexity], ["doc_id", "lang", "n_grams", "perplexity"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, n_grams long, perplexity double")


def quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """(name, value) from (name, level, value), ``level`` rising with ``value``: the least value that at least this share of a name's values does not exceed.

    The cell that holds it is found by counts, then the value in that cell.
    """
    counted = rows.withColumn("cell", F.floor(F.col("level") * CELLS)).groupBy("name", "cell", "value").agg(F.count("*").alias("n"))
    counted, path = stored(counted, "kn-quantiles")
    by_cell = Window.partitionBy("name").orderBy("cell")
    cells = counted.groupBy("name", "cell").agg(F.sum("n").alias("n"))
    cells = cells.withColumn("upto", F.sum("n").over(by_cell)).withColumn("wanted", F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.sum("n").over(Window.partitionBy("name")))))
    cells = cells.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).select("name", "cell", (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"))
    # one row for each name
    inside = counted.join(F.broadcast(cells), ["name", "cell"]).withColumn("upto", F.sum("n").over(Window.partitionBy("name").orderBy("value")))
    found = written(inside.where("upto >= wanted").groupBy("name").agg(F.min("value").alias("value")), "kn-quantile")
    release(rows.sparkSession, path)
    return found


def thresholds(held_out: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold) from held-out scores (lang, perplexity)."""
    level = F.log("perplexity")
    # one row for each language of the model
    centres = written(held_out.groupBy("lang").agg(F.count("*").alias("n"), F.avg(level).alias("centre")), "kn-centres")
    known = held_out.join(F.broadcast(centres), "lang")
    ratio = level - F.col("centre")
    many = known.where(F.col("n") >= ENOUGH)
    rows = many.select(F.concat(F.lit("="), "lang").alias("name"), level.alias("level"), F.col("perplexity").alias("value"))
    rows = rows.unionByName(many.select(F.lit("enough").alias("name"), ratio.alias("level"), ratio.alias("value")))
    rows = rows.unionByName(known.select(F.lit("all").alias("name"), ratio.alias("level"), ratio.alias("value")))
    found = quantiles(rows, quantile)
    pooled = {r["name"]: r["value"] for r in found.where("name in ('enough', 'all')").collect()}
    spread = F.lit(pooled.get("enough", pooled.get("all"))).cast("double")
    own = found.select(F.expr("substr(name, 2)").alias("lang"), F.col("value").alias("own"), F.expr("substr(name, 1, 1)").alias("sign")).where("sign = '='").drop("sign")
    return centres.join(own, "lang", "left").select("lang", F.coalesce("own", F.exp(F.col("centre") + spread)).alias("threshold"))


def trusted_rows(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, lang, text) whose id is trusted and whose text is not empty."""
    ids = trusted_ids.toDF("doc_id").select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    # rows without a mark are passed over where they are read; ids are hashed to partitions at every size, never broadcast
    some = marked(docs.where("doc_id is not null and text <> ''"), "doc_id", id_marks(ids))
    return some.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def learn(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> tuple[Model, DataFrame]:
    """The model of the trusted documents among ``docs`` (doc_id, lang, text), and the thresholds of its languages, stored."""
    trusted, path = stored(trusted_rows(docs, trusted_ids).withColumn("fold", _fold(F.col("text"))), "kn-trusted")
    model = store(trusted)
    held_out = score(trusted.withColumn("lang", _name(F.col("fold"), F.col("lang"))), model)
    held_out = written(held_out.where(F.col("perplexity").isNotNull()).select(_language(F.col("lang")).alias("lang"), "perplexity"), "kn-held-out")
    release(docs.sparkSession, path)
    return model, written(thresholds(held_out, quantile), "kn-thresholds")


def _verdict(n_grams: Column, perplexity: Column, threshold: Column) -> Column:
    return F.when(n_grams == 0, False).otherwise(F.coalesce(perplexity <= threshold, F.lit(True)))


def classify(df: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, n_grams, perplexity, threshold, kept.

    ``trusted_ids`` has one column, the ids whose documents are trusted.
    """
    arrow_batches(df.sparkSession)
    docs = _named(df, id_col, text_col, lang_col)
    model, limits = learn(docs, trusted_ids, quantile)
    scored = score(docs.withColumn("lang", _name(F.lit(WHOLE), F.col("lang"))), model).withColumn("lang", _language(F.col("lang")))
    known = scored.join(F.broadcast(limits), "lang", "left")
    return known.select("doc_id", "lang", "n_grams", "perplexity", "threshold", _verdict(F.col("n_grams"), F.col("perplexity"), F.col("threshold")).alias("kept"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good and not as toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id")


def keep(df: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are kept, with all their columns; each row is judged by its own text and language, with or without an id."""
    arrow_batches(df.sparkSession)
    model, limits = learn(_named(df, id_col, text_col, lang_col), trusted_ids, quantile)

    @F.arrow_udf("n_grams long, perplexity double")
    def judged(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for _, n_grams, perplexity in _scored((pa.RecordBatch.from_arrays([langs, texts], ["lang", "text"]) for langs, texts in columns), model):
            yield pa.StructArray.from_arrays([n_grams, perplexity], ["n_grams", "perplexity"])

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    scored = df.withColumn("_kneser_ney", judged(_name(F.lit(WHOLE), lang), F.col(text_col).cast("string"))).withColumn("_kneser_ney_lang", lang)
    known = scored.join(F.broadcast(limits.select(F.col("lang").alias("_kneser_ney_lang"), F.col("threshold").alias("_kneser_ney_threshold"))), "_kneser_ney_lang", "left")
    return known.where(_verdict(F.col("_kneser_ney.n_grams"), F.col("_kneser_ney.perplexity"), F.col("_kneser_ney_threshold"))).drop("_kneser_ney", "_kneser_ney_lang", "_kneser_ney_threshold")
