"""Token ids in files of directly addressable codes.

An id is split into 8-bit chunks, the lowest first.  Level k holds the k-th
chunk of every id that has one, and a continuation bitmap that says which of
them go on; a rank directory (ones before each 512-bit block) leads from a
place on one level to the place on the next.  Any id is read from a few bytes
on each level, without decoding what stands before it.

Layout (little-endian): ``DAC1``, ids, documents, levels (3 x uint64); document
starts (documents + 1 x uint64); for each level its length (uint64), its chunks,
its bitmap padded to 8 bytes, and its directory (uint64 for each block).  The
last level has no bitmap bit set.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.bpe import byte_letters
from shortlist.llm.common import coded_words, gather, new_folder, per_worker, slices, store

MAGIC = b"DAC1"
BLOCK = 512
#: Ids gathered before a file is written (a longer document makes a longer file).
FILE_IDS = 1 << 21


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A file's bytes: ``ids`` (unsigned 32-bit) and document starts (documents + 1)."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while len(rest):
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        rest = rest[more] >> 8
    out = [MAGIC, np.array([len(ids), len(starts) - 1, len(levels)], "<u8").tobytes(), np.asarray(starts, "<u8").tobytes()]
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % 8))
        ones = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), np.arange(0, len(bits), BLOCK // 8))
        rank = np.cumsum(ones) - ones
        out += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bits.tobytes(), rank.astype("<u8").tobytes()]
    return b"".join(out)


class Reader:
    """Random access to the ids of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC file")
        self.n, docs, levels = (int(x) for x in np.frombuffer(data, "<u8", 3, 4))
        self.starts = np.frombuffer(data, "<u8", docs + 1, 28).astype(np.int64)
        at, self.levels = 28 + 8 * (docs + 1), []
        for _ in range(levels):
            size = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            width = -(-size // 64) * 8
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, width, at + size)
            blocks = -(-width // (BLOCK // 8))
            rank = np.frombuffer(data, "<u8", blocks, at + size + width).astype(np.int64)
            # The ones before each 64-bit word, from the directory and the words of its block.
            ones = np.bitwise_count(bits.view("<u8")).astype(np.int64)
            before = np.cumsum(ones) - ones
            block = np.arange(len(ones)) // (BLOCK // 64)
            self.levels.append((chunks, bits, before - before[block * (BLOCK // 64)] + rank[block]))
            at += size + width + 8 * blocks

    @staticmethod
    def _ones_before(bits: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the ones before its word, then a masked word."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return rank[word] + np.bitwise_count(bits.view("<u8")[word] & below)

    def get(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.uint32)
        who = np.arange(len(places))
        for level, (chunks, bits, rank) in enumerate(self.levels):
            out[who] |= chunks[places].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            if not more.any():
                break
            who, places = who[more], self._ones_before(bits, rank, places[more])
        return out

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Ids at the places ``lo`` to ``hi - 1``, which lie side by side on every level."""
        out, who = np.zeros(hi - lo, np.uint32), slice(None)
        for level, (chunks, bits, rank) in enumerate(self.levels):
            if lo == hi:
                break
            out[who] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            first = lo & ~7
            more = np.flatnonzero(np.unpackbits(bits[lo >> 3:-(-hi // 8)], bitorder="little")[lo - first:hi - first])
            who = more if level == 0 else who[more]
            if len(more):
                lo = int(self._ones_before(bits, rank, np.array([lo]))[0])
            else:
                lo = 0
            hi = lo + len(more)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))


#: What lets words be cut before the library's model sees them: a normaliser that leaves words between spaces
#: apart, and pieces that are contractions, runs of letters, single numbers or runs of anything else.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
UNSEEN, SPACE, LETTER, NUMBER, OTHER = range(5)


class LibraryIds:
    """words -> (flat ids, starts, lengths), each word encoded by the tokenizers library.

    White space never joins what stands on its two sides in such files (it is
    normalised and dropped), so words between ASCII white space encode alone
    as they do within their text.  With ``NORMALIZER`` and ``SPLITTER`` many
    words are normalised at once (ASCII only needs lower case) and cut where the
    kinds of their characters change (the library tells the kind of each); its
    model then sees each distinct piece once.  Words with an apostrophe, a
    special token or white space beyond ASCII, and all words of other files, go
    to the library whole.  Up to ``keep`` pieces and whole words stay known for
    later calls; then all are dropped and gathered anew.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        self.cuts = (spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER
                     and not any(t["normalized"] for t in added))
        self.uncut = re.compile("|".join(["'", r"[^\S ]", *(re.escape(t["content"]) for t in added)]))
        self.model = Tokenizer(self.tokenizer.model)
        self.letters = dict(enumerate(byte_letters()))
        self.kinds = np.full(0x110000, UNSEEN, np.uint8)
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()       # pieces, and whole words after a space: their numbers
        self.known.default_factory = self.known.__len__
        self.flat, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _kind(self, char: str) -> int:
        """The kind of a normalised character, as the file's splitter has it."""
        def pieces(text: str) -> int:
            return len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return SPACE if not pieces(char) else LETTER if pieces("a" + char) == 1 else OTHER if pieces("!" + char) == 1 else NUMBER

    def _pieces(self, words: list[str]) -> tuple[list[str], np.ndarray] | None:
        """Normalised pieces of the words, one after another, and each word's number of them; None if they don't come apart."""
        text = " ".join(words)
        text = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[codes]
        if not kinds.all():
            new = np.unique(codes[kinds == UNSEEN])
            self.kinds[new] = [self._kind(chr(c)) for c in new.tolist()]
            kinds = self.kinds[codes]
        gap = kinds == SPACE
        begins = (kinds == NUMBER) | gap
        begins[0] = True
        begins[1:] |= kinds[1:] != kinds[:-1]
        at = np.flatnonzero(begins)
        real = ~gap[at]
        count = np.bincount(np.cumsum(~real)[real], minlength=len(words))
        if len(count) != len(words) or not count.all() or "'" in text:
            return None
        ends = np.append(at[1:], len(codes))
        return [text[a:b] for a, b in zip(at[real].tolist(), ends[real].tolist())], count

    @staticmethod
    def _encode(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of words, each taken alone."""
        flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for lo in range(0, len(words), 4096):
            part = words[lo:lo + 4096]
            got = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(got.ids, np.uint32))
            lengths.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)).astype(np.int64))
        return np.concatenate(flat), np.concatenate(lengths)

    def _whole(self, words: list[str]) -> np.ndarray:
        """Which of the words go to the library whole."""
        whole = np.full(len(words), not self.cuts)
        hits = [m.start() for m in self.uncut.finditer(" ".join(words))]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        whole[np.searchsorted(ends, hits, "right")] = True
        return whole

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) > self.keep:
            self._clear()
        known, had = self.known, len(self.known)
        whole, plain = self._whole(words), np.fromiter(map(str.isascii, words), bool, len(words))
        places, order, counts = [], [], [np.empty(0, np.int64)]      # words as handled, their units, units of each
        for some in (np.flatnonzero(plain & ~whole).tolist(), np.flatnonzero(~plain & ~whole).tolist()):
            for lo in range(0, len(some), 4096):
                part = some[lo:lo + 4096]
                if (got := self._pieces([words[i] for i in part])) is None:
                    whole[part] = True
                    continue
                order += map(known.__getitem__, got[0])
                counts.append(got[1])
                places += part
        pieces = len(known) - had
        rest = np.flatnonzero(whole).tolist()
        order += [known[" " + words[i]] for i in rest]
        counts.append(np.ones(len(rest), np.int64))
        places += rest
        new = list(islice(known, had, None))
        spelled = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in new[:pieces]]
        got = self._encode(self.model, spelled), self._encode(self.tokenizer, [w[1:] for w in new[pieces:]])
        self.flat = np.concatenate([self.flat, *(flat for flat, _ in got)])
        self.lengths = np.concatenate([self.lengths, *(lengths for _, lengths in got)])
        units = np.array(order, np.int64)
        own = self.lengths[units]
        flat = self.flat[gather((np.cumsum(self.lengths) - self.lengths)[units], own)]
        edge = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(np.concatenate(counts))])]
        back = np.empty(len(words), np.int64)
        back[places] = np.arange(len(words))
        return flat, edge[:-1][back], np.diff(edge)[back]


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None,
              id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode texts and write their ids, in ascending id order, as files of directly addressable codes.

    Each text's ids are followed by ``end_id``; null texts count as empty.
    Null ids come first; rows with equal ids are all written.  Returns the
    stored list of files: file, first (its smallest id), part, block, n_docs, n_ids,
    base (ids in all files before it).  Files of a lost task attempt are never listed.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange(parts, F.col("id").asc_nulls_first())
               .sortWithinPartitions(F.col("id").asc_nulls_first()))
    schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("part", pa.int32()), ("block", pa.int32()),
                        ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("library", path), lambda: LibraryIds(path))
        store_fs, root = fs.FileSystem.from_uri(folder)
        store_fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        block, names, held, sizes, total = 0, [], [], [], 0

        def flush():
            nonlocal block, names, held, sizes, total
            lengths = np.concatenate(sizes)
            doc_ids = pa.concat_arrays(names)
            name = f"part-{part:05d}-{block:05d}-{uuid.uuid4().hex}"
            with store_fs.open_output_stream(f"{root}/{name}.dac") as out:
                out.write(pack(np.concatenate(held), np.concatenate([[0], np.cumsum(lengths)])))
            with store_fs.open_output_stream(f"{root}/{name}.docs") as out, \
                    pa.ipc.new_stream(out, pa.schema([("id", doc_ids.type)])) as rows:
                rows.write_batch(pa.RecordBatch.from_arrays([doc_ids], names=["id"]))
            row = [f"{folder}/{name}", doc_ids[0].as_py(), part, block, len(lengths), total]
            block, names, held, sizes, total = block + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema)], schema=schema)
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                words, index, offsets = coded_words(piece.column("text"))
                flat, starts, lengths = encode(words)
                own = lengths[index]
                edge = np.concatenate([[0], np.cumsum(own)])[offsets]
                size = np.diff(edge)
                ids = flat[gather(starts[index], own)]
                held.append(np.insert(ids, edge[1:], end_id).astype(np.uint32))
                names.append(piece.column("id"))
                sizes.append(size + 1)
                total += len(ids) + len(size)
                if total >= file_ids:
                    yield flush()
        if total:
            yield flush()
    files = store(ordered.mapInArrow(run, "file string, first bigint, part int, block int, n_docs bigint, n_ids bigint"), "id-files")
    order = Window.orderBy(F.col("first").asc_nulls_first(), "part", "block")
    before = F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0)))


def read_ids(files: DataFrame, digest: bool = False) -> DataFrame:
    """Rows of the listed files: id, start, n_tokens, and ids (or their crc32)."""
    spark = files.sparkSession
    spread = files.select("file", "base").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    kind = "ids_crc32 bigint" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                store_fs, name = fs.FileSystem.from_uri(name)
                with store_fs.open_input_stream(f"{name}.dac") as src:
                    reader = Reader(src.read())
                with store_fs.open_input_stream(f"{name}.docs") as src, pa.ipc.open_stream(src) as rows:
                    doc_ids = rows.read_all().column("id").combine_chunks()
                starts = reader.starts
                for lo in range(0, len(doc_ids), 2000):
                    hi = min(lo + 2000, len(doc_ids))
                    ids = reader.span(int(starts[lo]), int(starts[hi]))
                    cuts = (starts[lo:hi + 1] - starts[lo]).tolist()
                    if digest:
                        raw = memoryview(ids.astype("<u4")).cast("B")
                        last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
                    else:
                        last = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(lo, hi - lo), pa.array(starts[lo:hi] + base), pa.array(np.diff(cuts).astype(np.int64)), last],
                        names=["id", "start", "n_tokens", kind.split()[0]])
    return spread.mapInArrow(run, f"id bigint, start bigint, n_tokens bigint, {kind}")
