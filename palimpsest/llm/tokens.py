"""Token ids of words, and a binary file format for them.

``WordEncoder`` applies a tokenizer whose pieces never cross white space.  A
text is cut at spaces and line ends, a chunk into a word and the signs after it
where the tokenizer cuts there too; each distinct part is encoded once.

The format ranks ids by frequency (commonest first) and stores ranks in one to
four whole bytes.  Lengths stand apart from the values, four of them to a
control byte, so a reader looks up the byte pattern of four values at once.

Defined cases: a null text counts as empty (only the end id), a null doc_id
comes first, repeated doc_ids are kept, in an order fixed by their content.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_batches, filesystem, kept, release, slices, stored, texts_of, workspace, written


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file, without the tokens that frame a text.

    The strings of special tokens have no white space, so they are found in a
    chunk where they are found in the text, and get their own ids.
    """

    #: Chunks kept in each of two generations.
    KEPT = 220_000
    #: Longer chunks are not kept.
    LONGEST = 64
    #: Characters one of which stands alone between chunks that lack it; its id marks where they end.
    MARKS = "~^`|@=_+*#$%&"
    #: Signs that may end a chunk; a word is encoded once for all the signs that follow it.
    SIGNS = ".,;:!?\"()[]{}<>|/#$%&*"

    def __init__(self, path: str, most: int = KEPT):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {c: int(self._ids(c)[0]) for c in self.MARKS if len(self._ids(c)) == 1}
        # what this tokenizer does with words and signs is asked of it
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda text: [(text, (0, len(text)))]
        alone = all(normal(f"a{c}") in (f"a{c}", f"A{c}") and [at for _, at in pieces(f"a{c}{d}")] == [(0, 1), (1, 3)] for c in self.SIGNS for d in self.SIGNS)
        self.signs = self.SIGNS if alone else ""
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.lowers = normal(letters.upper()) == letters
        # ids that end a word, if the tokenizer has such
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(size, bool)
        if suffix:
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _split(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks by one call: they are joined by a mark and cut at its id."""
        if not chunks:
            return []
        together = "".join(chunks)
        mark = next((c for c in self.marks if c not in together), None)
        if mark is None:
            return [self._ids(c).tobytes() for c in chunks]
        ids = np.array(self.tokenizer.encode_batch_fast([f" {mark} ".join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(ids == self.marks[mark])
        if len(cut) != len(chunks) - 1:  # a tokenizer that makes the mark's id of other characters too
            return [self._ids(c).tobytes() for c in chunks]
        width, raw = self.dtype.itemsize, ids.tobytes()
        starts = np.concatenate(([0], cut + 1)) * width
        ends = np.concatenate((cut, [len(ids)])) * width
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of many words of letters by one call, cut after the ids that end a word.

        A word has one such id at least, so if there are as many of them as words each has one.
        """
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._split(words)
        ends = (ends * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of words, signs and other chunks; those seen lately are known."""
        young, old = self.young, self.old
        out = list(map(young.get, parts))
        missing = [k for k, value in enumerate(out) if value is None]
        words, others = [], []
        for k, value in zip(missing, [old.get(parts[k]) for k in missing]):
            if value is not None:
                out[k] = young[parts[k]] = value
            elif parts[k].isalpha():
                words.append(k)
            else:
                others.append(k)
        for fresh, call in ((words, self._words), (others, self._split)):
            chunks = [parts[k] for k in fresh]
            for k, chunk, value in zip(fresh, chunks, call(chunks)):
                out[k] = value
                if len(chunk) <= self.LONGEST:
                    young[chunk] = value
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out

    def _parted(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words in lower case and the signs after them; a chunk that is no such word stays whole, without signs."""
        words = pa.compute.utf8_rtrim(chunks, self.signs) if self.signs else chunks
        plain = pa.compute.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        # letters that become a letter and a mark would join the signs
        split = [c for c in set(raw_text(words)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
        if split:
            plain &= ~pa.compute.match_substring_regex(words, f"[{''.join(split)}]").to_numpy(zero_copy_only=False)
        words = pa.compute.if_else(pa.array(plain), pa.compute.ascii_lower(words) if self.lowers else words, chunks)
        edges = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        raw = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        sizes = pa.compute.binary_length(words).to_numpy(zero_copy_only=False)
        rest = np.diff(edges) - sizes
        ends = np.cumsum(rest)
        signs = raw[np.repeat(edges[:-1] + sizes - (ends - rest), rest) + np.arange(rest.sum())]
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        return words, pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(offsets), pa.py_buffer(signs))

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has."""
        words, signs = (part.dictionary_encode() for part in self._parted(chunks))
        known = self._ids_of(words.dictionary.to_pylist() + signs.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        which = np.stack([words.indices.to_numpy(), signs.indices.to_numpy() + len(words.dictionary)], axis=1)
        flat = _gathered(np.frombuffer(b"".join(known), self.dtype), lengths, which.reshape(-1))
        return flat, lengths[which].sum(axis=1)

    def encode(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, ``end`` last if there is one."""
        cut = pa.compute.split_pattern(pa.compute.replace_substring(pa.array([t or "" for t in texts], pa.large_string()), "\n", " "), " ")
        coded = cut.values.dictionary_encode()
        place = coded.indices.to_numpy()
        ids, lengths = self._distinct(coded.dictionary)
        flat = _gathered(ids, lengths, place)
        edges = np.concatenate(([0], np.cumsum(lengths[place])))[np.asarray(cut.offsets)]
        if end is None:
            return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        flat = np.insert(flat, edges[1:], end)
        edges += np.arange(len(edges))
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def raw_text(column: pa.Array) -> str:
    """All texts of a column without gaps or nulls, one after the other."""
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return bytes(memoryview(column.buffers()[2] or b"")[edges[0] : edges[-1]]).decode()


def _gathered(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, which has one of each length after the other, in the order of ``which``."""
    n = lengths[which]
    source = np.repeat((np.cumsum(lengths) - lengths)[which] - (np.cumsum(n) - n), n)
    source += np.arange(len(source))
    return flat[source]


def encoder(path: str, most: int = WordEncoder.KEPT) -> WordEncoder:
    """One encoder in each Python process; its kept chunks, ``most`` in each generation, serve later tasks."""
    return kept(("words", path, most), lambda: WordEncoder(path, most))


def encode_texts(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (bytes, little-endian, 2 or 4 to an id), the end id last."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in slices(batches, "text", 6_000_000):
            ids = words.encode(batch.column("text").to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


# ---------------------------------------------------------------- the coding

#: For each control byte, which of 4 x 4 bytes are stored.
_PATTERN = np.arange(4) <= ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3)[:, :, None]
_STORED = _PATTERN.sum(axis=(1, 2))


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    fours[: len(ranks)] = extra
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    stored = np.arange(4) <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[stored].tobytes()


def unpack_ranks(control: bytes, values: bytes, n: int) -> np.ndarray:
    """The numbers again: one table lookup gives the bytes that four values store."""
    stored = _PATTERN[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[stored] = np.frombuffer(values, np.uint8)
    return out.view("<u4").reshape(-1)


def _flat(column: pa.Array, dtype: str) -> np.ndarray:
    """All numbers of a column of byte strings, one after the other, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)


def frequency_ranks(encoded: DataFrame, size: int, width: int) -> np.ndarray:
    """``by_rank``: ids by falling count, then by id.  At most ``size`` rows reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column(0), f"<u{width}"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size, np.int64)
    n[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return np.lexsort((np.arange(size), -n)).astype("<u4")


# ------------------------------------------------------------- the file format

MAGIC = b"PVB1"
_HEAD = struct.Struct("<IQQQ")  # documents, tokens, control bytes, value bytes


def write_block(out, doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> None:
    """A block: head, null flags, doc ids, token counts, then all control bytes, then all values."""
    control, values = pack_ranks(ranks)
    out.write(_HEAD.pack(len(doc_ids), len(ranks), len(control), len(values)))
    out.write(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(counts.astype("<i8").tobytes())
    out.write(control)
    out.write(values)


def read_blocks(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, token counts, ranks of all their tokens) of each block in a file."""
    if source.read(4) != MAGIC:
        raise ValueError("not a token file")
    while head := source.read(_HEAD.size):
        n, n_tokens, n_control, n_values = _HEAD.unpack(head)
        known = np.frombuffer(source.read(n), np.uint8)
        ids, counts = (np.frombuffer(source.read(8 * n), "<i8") for _ in range(2))
        doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        yield doc_ids, counts, unpack_ranks(source.read(n_control), source.read(n_values), n_tokens)


def write_token_files(encoded: DataFrame, folder: str, by_rank: np.ndarray, width: int) -> DataFrame:
    """Write the documents in ascending doc_id order; returns the files: name, part, documents, tokens.

    Each task writes one file under a name of its own attempt; the returned
    table, itself committed by Spark, names the files that count.
    """
    rank = np.empty(len(by_rank), "<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, top = filesystem(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.pvb"
        out, n_docs, n_tokens = None, 0, 0
        for batch in slices(batches, "ids"):
            if out is None:
                system.create_dir(top, recursive=True)
                out = system.open_output_stream(f"{top}/{name}")
                out.write(MAGIC)
            counts = batch.column(1).to_numpy()
            write_block(out, batch.column(0).to_pylist(), counts, rank[_flat(batch.column(2), f"<u{width}")])
            n_docs, n_tokens = n_docs + len(counts), n_tokens + int(counts.sum())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task.partitionId()], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["name", "part", "n_docs", "n_tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(store, "name string, part long, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, by_rank: np.ndarray, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids (unsigned 32-bit, little-endian).

    One row for each file reaches the driver, to add up where each file begins.
    """
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((row["name"], start))
        start += row["n_tokens"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{top}/{name}") as source:
                    for doc_ids, counts, ranks in read_blocks(source):
                        ids = by_rank[ranks]
                        ends = np.cumsum(counts)
                        raw = [ids[a:b].data for a, b in zip((ends - counts).tolist(), ends.tolist())]
                        out = [pa.array(doc_ids, pa.int64()), pa.array(at + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            out.append(pa.array([bytes(x) for x in raw], pa.binary()))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(out, names)
                        at += len(ids)

    table = spark.createDataFrame(files, "name string, start long")
    if len(files) > 1:
        table = table.repartition(len(files))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_files(df: DataFrame, path: str, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write them as token files into the shared folder, and read the files back."""
    spark = df.sparkSession
    words = encoder(path)
    width = words.dtype.itemsize
    encoded, encoded_path = stored(encode_texts(df, path, end_id, id_col, text_col), "token-ids", "zstd")
    by_rank = frequency_ranks(encoded, max(words.size, end_id + 1), width)
    folder = workspace(spark, "token-files")
    manifest = write_token_files(encoded, folder, by_rank, width)
    release(spark, encoded_path)
    return read_token_files(spark, folder, manifest, by_rank, with_ids)
