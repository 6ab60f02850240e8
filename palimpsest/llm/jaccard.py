"""Jaccard join on word shingles, and the groups its links form.

Words are runs of other characters than space and U+0009 to U+000D, A-Z in
lower case; a document's set holds its distinct n-word shingles as 64-bit
hashes (a text with fewer words is one shingle).  Two documents link when
``den * |A and B| >= num * |A or B|``.

Plan.  Documents with equal sets become one class.  Shingles are ordered rare
first by a table of fixed size that counts them over all documents; a class is
indexed under its prefix, the first ``|A| - ceil(num |A| / den) + 1`` shingles.
Classes that share a prefix shingle are candidates, subject to three filters:
their lengths, the positions of the shared shingle, and the suffix filter.  For
the last, a set's shingles are dealt by hash into parts, and a bit for each
part says whether it holds an odd number of them.  Sets whose bits differ in d
parts differ in d shingles at least.  The number of parts follows the size of
the set, so the bound is close for short and long texts alike.  Each pair that
passes is verified once on its sets.

Groups of many near copies would make the square of their size in pairs.  So a
first round compares the members of each index entry with its shortest, its
longest and its most central member only (the one with the fewest rare shingles
before the shared one).  Links found so far give components; the second round
lists, entry by entry and by length, just pairs of members of different
components, and takes a pair at the first shingle that its prefixes share.  Of
these pairs each member's nearest (by parities) is verified first, a few times
where many are left; what is then still between components is verified last.  Pairs inside a component cannot
change the result, so the components are exact.  ``linked_pairs`` gives all
links instead.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; a null doc_id has no component; rows with one doc_id are one document,
linked by each of its texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Tables, arrow_batches, kept, slices, stored, texts_of

#: Entries of the table that orders shingles, and of a chunk of it; its size does not depend on the input.
BUCKETS, CHUNK = 1 << 24, 1 << 12
#: Parts that a set is dealt into for the suffix filter: four for each shingle, rounded to a power of two, within these.
LEAST_PARTS, MOST_PARTS = 64, 1 << 15
#: Parts that go with each posting; the whole number of parts is compared once for each pair.
BRIEF_PARTS = 512
#: Shingles at the head of a prefix by which a pair is known to have been listed before.
HEAD = 8
#: Rounds in which the nearest pairs are verified before all that are left; one if there are fewer than this many for each nearest pair.
ROUNDS, FEW = 3, 16
#: Bits of the table that picks the documents whose sets are made: so many for each document, within these bounds.
MARKS_EACH, LEAST_MARKS, MOST_MARKS = 16, 1 << 16, 1 << 27
_WORDS_KEPT = 200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the output."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(kept("hashes", _Words).__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _MULTIPLIER + hashes[k : len(words) - width + 1 + k]
    return np.unique(_mixed(h))


def _packed(counts: np.ndarray) -> tuple[bytes, bytes, int]:
    """Counts of a chunk: places (none if all are stored), numbers, and bytes in a number."""
    used = np.flatnonzero(counts)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 8
    if len(used) * (2 + width) < CHUNK * width:
        return used.astype("<u2").tobytes(), counts[used].astype(f"<u{width}").tobytes(), width
    return b"", counts.astype(f"<u{width}").tobytes(), width


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact up to 15, then in quarters of a doubling."""
    return np.where(counts < 16, counts, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def shingle_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles of each bucket occur, over all documents, as levels; BUCKETS bytes reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint16)
        high = 0
        for batch in slices(batches, "text", 1_000_000):
            found = np.concatenate([shingle_set(text, n) for text in batch.column("text").to_pylist()])
            buckets, times = np.unique((found & np.uint64(BUCKETS - 1)).astype(np.uint32), return_counts=True)
            top = int(times.max(initial=0))
            if high + top >= 1 << 16:  # the counters are full: pass them on and begin again
                yield from chunks(total)
                total[:] = 0
                high = 0
            wide = times >= 1 << 16
            if wide.any():
                more = np.zeros(BUCKETS, np.uint32)
                more[buckets[wide]] = times[wide]
                yield from chunks(more)
                buckets, times, top = buckets[~wide], times[~wide], int(times[~wide].max(initial=0))
            total[buckets] += times.astype(np.uint16)
            high += top
        yield from chunks(total)

    def chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        grid = total.reshape(-1, CHUNK)
        for part in np.array_split(np.flatnonzero(grid.any(axis=1)), 16):
            rows = [(k, *_packed(grid[k])) for k in part.tolist()]
            if rows:
                chunk, at, times, width = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(at, pa.binary()), pa.array(times, pa.binary()), pa.array(width, pa.int32())], ["chunk", "at", "n", "width"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, times, width in zip(*(c.to_pylist() for c in batch.columns)):
                own = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
                own[np.frombuffer(at, "<u2") if at else slice(None)] += np.frombuffer(times, f"<u{width}").astype(np.int64)
        for chunk, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([_levels(own).tobytes()], pa.binary())], ["chunk", "levels"])

    parts = docs.select("text").mapInArrow(count, "chunk int, at binary, n binary, width int").repartition("chunk")
    out = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint8)
    for row in parts.mapInArrow(add, "chunk int, levels binary").collect():
        out[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def parities(shingles: np.ndarray, most: int = MOST_PARTS) -> np.ndarray:
    """A bit for each part of the set: whether it holds an odd number of shingles."""
    parts = min(most, max(LEAST_PARTS, 1 << max(0, 4 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def profiles(docs: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Per document: size and identity of its set, its prefix in rare-first order, and the parities of its parts."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in slices(batches, "text"):
            sizes, names, prefixes, odd, brief = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n)
                size = len(s)
                keep = size - -(-num * size // den) + 1 if size else 0
                by_rank = np.lexsort((s, rare[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:keep]
                sizes.append(size)
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefixes.append(s[by_rank].view(np.int64))
                odd.append(parities(s))
                brief.append(parities(s, BRIEF_PARTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(brief, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "prefix", "odd", "brief"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, prefix array<long>, odd array<long>, brief array<long>")


def needed(a: Column, b: Column, num: int, den: int) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil((a + b) * F.lit(num) / F.lit(num + den) - F.lit(1e-9)).cast("long")


def _apart(a: Column, b: Column) -> Column:
    """In how many parts two sets differ by their parities; null where one is more than twice as fine as the other."""

    def half(odd: Column) -> Column:
        words = (F.size(odd) / 2).cast("int")
        return F.zip_with(F.slice(odd, F.lit(1), words), F.slice(odd, words + 1, words), lambda p, q: p.bitwiseXOR(q))

    even = F.zip_with(F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(even, F.lit(0), lambda t, d: t + d)


def _near(a: Column, b: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """Suffix filter: sets whose parities differ in more parts than sets that link can differ in shingles do not link."""
    return F.coalesce(_apart(a, b) <= n_a + n_b - 2 * needed(n_a, n_b, num, den), F.lit(True))


def _tables(df: DataFrame) -> Tables:
    return Tables(df.sparkSession, "jaccard")


def verified(pairs: DataFrame, index: DataFrame, docs: DataFrame, n: int, num: int, den: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) whose sets link, stored in ``tables``.  ``index``: node, n, odd; ``docs``: doc_id, text.

    Sets are made for documents of pairs that pass the filters, by one more
    scan of the texts: no text is shuffled.
    """
    own = _tables(pairs)
    info = lambda side: index.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("odd").alias(f"odd_{side}"))
    known = pairs.join(info("a"), "a").join(info("b"), "b")
    known = known.where(_near(F.col("odd_a"), F.col("odd_b"), F.col("n_a"), F.col("n_b"), num, den))
    known = own.store(known.select("a", "b").distinct(), "pairs")
    ends = known.select(F.col("a").alias("node")).unionByName(known.select(F.col("b").alias("node"))).distinct()
    sets = own.store(_sets(docs, _marks(ends), n), "sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s_{s}"))
    both = known.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    links = both.withColumn("common", common).where(F.col("common") * den >= (F.size("s_a") + F.size("s_b") - F.col("common")) * num)
    links = tables.store(links.select("a", "b").distinct(), "links")
    own.release()
    return links


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches, stored in ``tables``.

    Alternates two steps until nothing changes: every node ties its larger
    neighbours to the least node around it, then its smaller ones.
    """
    before, now = _tables(edges), _tables(edges)
    edges = before.store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = before.store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = before.store(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = now.store(small, "edges")
        # no repeated edges on either side: as many, and all known, are the same
        changed = small.count() != edges.count() or small.join(edges, ["u", "v"], "left_anti").limit(1).count() > 0
        before.release()
        before, now, edges = now, before, small
        if not changed:
            # every node now has one edge, to the least node of its component
            tables.take(before)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Index:
    """The classes of equal sets, and the postings of prefix shingles that several classes share."""

    def __init__(self, df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        self.n, self.num, self.den, self.tables = n, num, den, _tables(df)
        arrow_batches(df.sparkSession)
        self.docs = texts_of(df, id_col, text_col)
        store, own = self.tables.store, _tables(df)
        # doc_id, n_shingles, set_id, prefix, odd, brief of every row
        profile = own.store(profiles(self.docs, shingle_levels(self.docs, n), n, num, den), "profiles")
        linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        usable = profile.where(linkable)
        #: doc_id, n_shingles of the rows that link with nothing
        self.alone = store(profile.where(~linkable).select("doc_id", "n_shingles"), "alone")
        classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("node"))
        # an id with several texts may be the least of several classes
        variant = F.row_number().over(Window.partitionBy("node").orderBy("set_id"))
        classes = own.store(classes.withColumn("variant", variant), "classes")
        #: doc_id, n_shingles and node, the least id of its class
        self.members = store(usable.select("doc_id", "n_shingles", "set_id").join(classes, "set_id").select("doc_id", "n_shingles", "node"), "members")
        # one document stands for each class; its prefix is needed for the postings only
        first = usable.join(classes.select(F.col("node").alias("doc_id"), "set_id", "variant"), ["doc_id", "set_id"])
        first = first.select(F.col("doc_id").alias("node"), "variant", F.col("n_shingles").alias("n"), "odd", "brief", "prefix")
        alike = ["node", "variant"]
        self.index = store(first.drop("prefix").dropDuplicates(alike), "index")
        listed = _tables(df)
        prefixes = listed.store(first.drop("odd", "brief").dropDuplicates(alike), "prefixes")
        own.release()
        postings = prefixes.select("node", "variant", F.posexplode("prefix").alias("pos", "token"), "n")
        tokens = listed.store(postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token"), "tokens")
        #: token, node, variant, pos, n of prefix shingles in two classes or more; released when the pairs are known
        self.listing = _tables(df)
        self.shared = self.listing.store(postings.join(tokens, "token"), "postings")
        listed.release()

    def same_id(self) -> DataFrame:
        """Links between classes that hold texts of one doc_id."""
        several = self.members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a < _last").select("doc_id", "a")
        return self.members.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))

    def stars(self) -> DataFrame:
        """Pairs of a member and the hub that it shares most prefix shingles with, stored."""
        own = _tables(self.shared)
        member = F.struct("n", "node", "pos")
        entries = own.store(self.shared.groupBy("token").agg(F.min(member).alias("shortest"), F.max(member).alias("longest"), F.min(F.struct("pos", "n", "node")).alias("central")), "entries")
        met = self.shared.join(entries, "token")

        def star(end: str) -> DataFrame:
            hub = F.col(end)
            fits = (F.least("n", hub["n"]) * self.den >= F.greatest("n", hub["n"]) * self.num) & (F.least(F.col("n") - F.col("pos"), hub["n"] - hub["pos"]) >= needed(F.col("n"), hub["n"], self.num, self.den))
            return met.where((F.col("node") != hub["node"]) & fits).select("node", hub["node"].alias("hub"))

        times = star("shortest").unionByName(star("longest")).unionByName(star("central")).groupBy("node", "hub").agg(F.count("*").alias("times"))
        best = times.groupBy("node").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("hub"))
        best = self.tables.store(best.select(*_pair(F.col("node"), F.col("hub"))).distinct(), "stars")
        own.release()
        return best

    def pairs(self, found: DataFrame | None = None) -> DataFrame:
        """Candidate pairs (a, b, apart), stored; with components ``found`` so far (node, component), only those between two of them."""
        own = _tables(self.shared)
        num, den, store = self.num, self.den, own.store
        placed = self.shared
        if found is None:
            placed = placed.withColumn("component", F.col("node"))
        else:
            placed = placed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # sets that link are in the same length band or in neighbouring ones
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
        longer = store(placed.withColumn("band", band), "placed")
        # the shorter set of a pair asks in both bands; its shingle is early enough for a partner as long as itself
        shorter = longer.where(F.col("n") - F.col("pos") >= needed(F.col("n"), F.col("n"), num, den)).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
        roles = shorter.select("token", "band", "component", F.lit(1).alias("role")).unionByName(longer.select("token", "band", "component", F.lit(2).alias("role")))
        live = roles.groupBy("token", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("role").alias("x"), F.max("role").alias("y"))
        live = store(live.where("lo < hi and x = 1 and y = 2").select("token", "band"), "live")
        shorter, longer = (store(side.join(live, ["token", "band"], "left_semi"), name) for side, name in ((shorter, "shorter"), (longer, "longer")))
        # the first shingles of each class that are listed at all
        listed = shorter.select("node", "variant", "pos", "token").unionByName(longer.select("node", "variant", "pos", "token"))
        head = listed.groupBy("node", "variant").agg(F.slice(F.sort_array(F.collect_set(F.struct("pos", "token"))), 1, HEAD).alias("head"))
        facts = store(head.join(self.index.select("node", "variant", "brief"), ["node", "variant"]), "heads")

        def side(rows: DataFrame, s: str) -> DataFrame:
            earlier = F.transform(F.filter("head", lambda t: t["pos"] < F.col("pos")), lambda t: t["token"])
            rows = rows.join(facts, ["node", "variant"]).withColumn("earlier", earlier)
            return rows.select("token", "band", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "component", "brief", "earlier")])

        n_x, n_y, brief = F.col("n_x"), F.col("n_y"), (F.col("brief_x"), F.col("brief_y"))
        meets = (F.struct("n_x", "node_x") < F.struct("n_y", "node_y")) & (F.col("component_x") != F.col("component_y")) & (n_x * den >= n_y * num)
        # the shared shingle and what can follow it on both sides
        meets &= F.least(n_x - F.col("pos_x"), n_y - F.col("pos_y")) >= needed(n_x, n_y, num, den)
        meets = meets & _near(*brief, n_x, n_y, num, den) & ~F.arrays_overlap("earlier_x", "earlier_y")
        found = side(shorter, "x").join(side(longer, "y"), ["token", "band"]).where(meets).select(*_pair(F.col("node_x"), F.col("node_y")), _apart(*brief).alias("apart"))
        found = self.tables.store(found.groupBy("a", "b").agg(F.min("apart").alias("apart")), "candidates")
        own.release()
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        return verified(pairs, self.index, self.docs, self.n, self.num, self.den, self.tables)


def similar_groups(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    return _groups(df, n, num, den, id_col, text_col)[0]


def _groups(df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, Tables]:
    """The rows of ``similar_groups``, and the stored tables that they read."""
    index = _Index(df, n, num, den, id_col, text_col)
    links = index.verified(index.stars()).unionByName(index.same_id())
    left = index.pairs(components(links, index.tables))
    index.listing.release()
    for k in range(ROUNDS):
        n_left = left.count()
        if not n_left:
            break
        ends = left.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("node"))
        nearest = ends.groupBy("node").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("pair"))
        nearest = index.tables.store(nearest.select("pair.a", "pair.b").distinct(), "nearest")
        links = links.unionByName(index.verified(nearest))
        found = components(links, index.tables)
        of = lambda side, found=found: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        left = left.join(nearest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = index.tables.store(left.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "apart"), "left")
        if n_left < FEW * nearest.count():
            break
    links = links.unionByName(index.verified(left.select("a", "b")))
    labels = components(links, index.tables)
    linked = index.members.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return linked.unionByName(index.alone.withColumn("component_id", F.col("doc_id"))), index.tables


def linked_pairs(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (doc_id, class_id) of each document, and the linked pairs (a, b) of different classes.

    A class is named by its least id; documents of one class have equal sets.
    """
    index = _Index(df, n, num, den, id_col, text_col)
    pairs = index.pairs().select("a", "b")
    index.listing.release()
    return index.members.select("doc_id", F.col("node").alias("class_id")).distinct(), index.verified(pairs)


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bit for each remainder that ids of ``nodes`` leave when divided by the number of bits; 32 bits to a row reach the driver."""
    marks = min(MOST_MARKS, max(LEAST_MARKS, 1 << (MARKS_EACH * nodes.count()).bit_length()))
    bit = F.pmod("node", F.lit(marks))
    rows = nodes.groupBy(F.floor(bit / 32).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {marks}) % 32 as int))")).alias("bits")).toPandas()
    out = np.zeros(marks // 32, np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _sets(docs: DataFrame, marks: np.ndarray, n: int) -> DataFrame:
    """(node, shingles) of documents whose id has its mark: all wanted ones, and some that share a remainder."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id")
            rest = ids.fill_null(0).to_numpy() % (32 * len(marked))
            wanted = (marked[rest >> 5] >> (rest & 31).astype(np.uint32) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted))
            sets = [shingle_set(t, n).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, shingles array<long>")


def one_of_each(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose document is the first of its group, with all their columns; null ids stay."""
    groups, tables = _groups(df, n, num, den, id_col, text_col)
    gone, _ = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    tables.release()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
