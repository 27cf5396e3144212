"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every distinct window of normalised words of the
benchmark.  Each text is normalised by a byte table that keeps its length (so
offsets lead back to the original), its words are joined by single spaces, and
the result is scanned once.

The benchmark is the small side: it is sent to the tasks in blocks of
``BLOCK_BYTES`` of text at most (or one item), one scan for each block.  Blocks
come one after another: each is fetched, scanned to a stored table and let go,
so the driver and the tasks hold one at a time whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import in_slices, map_slices, store, with_row_id

BLOCK_BYTES = 8 << 20

#: A-Z to a-z; a-z, 0-9 and bytes from 0x80 as they are; the rest to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))


def normal_words(text: str | None) -> list[str]:
    return (text or "").encode().translate(NORMAL).decode().split(" ")


def item_windows(text: str | None, window: int) -> set[str]:
    """The windows of an item; a shorter item with any word is one window."""
    words = [w for w in normal_words(text) if w]
    if not words:
        return set()
    return {" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[str | None, str | None]], window: int) -> ahocorasick.Automaton:
    """Words -> (number of words, positions in ``items`` that hold the window)."""
    owners: dict[str, list[int]] = {}
    for i, (_, text) in enumerate(items):
        for w in item_windows(text, window):
            owners.setdefault(w, []).append(i)
    found = ahocorasick.Automaton()
    for w, who in owners.items():
        found.add_word(f" {w} ", (w.count(" ") + 1, tuple(who)))
    if owners:
        found.make_automaton()
    return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's (id, text) rows in blocks of bounded size, fetched as they are asked for."""
    sizes = benchmark.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    if sizes <= block_bytes:
        yield [tuple(r) for r in benchmark.collect()]
        return
    count = -(-sizes // block_bytes) * 2
    part = F.pmod(F.xxhash64("text", "id"), F.lit(count))
    for i in range(count):
        yield [tuple(r) for r in benchmark.where(part == i).collect()]


def _scan(texts: DataFrame, sent: Broadcast, window: int) -> DataFrame:
    """rid, n_words, hit words, items found, for one block (id, text) of the benchmark."""
    def run(batches):
        found = automaton(sent.value, window)
        ids = [i for i, _ in sent.value]
        schema = pa.schema([("rid", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())),
                            ("items", pa.list_(pa.string()))])
        for batch in in_slices(batches, "text"):
            counts, hits, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = [w for w in normal_words(text) if w]
                counts.append(len(words))
                line = f" {' '.join(words)} "
                got = list(found.iter(line)) if words and len(found) else []
                marks, who = set(), set()
                seen, at = 0, 0
                for end, (length, owners) in got:  # ends come in ascending order
                    at += line.count(" ", seen, end)
                    seen = end
                    marks.update(range(at - length, at))
                    who.update(owners)
                hits.append(sorted(marks))
                items.append(sorted({str(ids[i]) for i in who if ids[i] is not None}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.string()))], schema=schema)
    return texts.mapInArrow(run, "rid bigint, n_words bigint, hits array<int>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                  id_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (a stored table): rid, n_words, hits (word numbers, ascending), items.

    A window is ``window`` consecutive words of a benchmark item, or all words
    of a shorter item; a document word inside any occurrence of a window is
    hit.  Null and empty texts have no words and no hits, items without words
    match nothing, a null item id is found but not named, repeated items count
    once, and an empty benchmark hits nothing.
    """
    texts = with_row_id(docs.select(F.col(text_col).alias("text")))
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    whole, ahead = None, None
    for block in _blocks(items, block_bytes):
        if ahead is not None:                        # another block follows: this one's scan is stored and let go
            part = store(_scan(texts.select("rid", "text"), ahead, window), "decontam")
            ahead.destroy()
            whole = part if whole is None else whole.unionByName(part)
        ahead = texts.sparkSession.sparkContext.broadcast(block)
    last = _scan(texts.select("rid", "text"), ahead, window)
    if whole is None:
        return last
    whole = whole.unionByName(store(last, "decontam"))
    ahead.destroy()
    return whole.groupBy("rid").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def hit_spans(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(rid, spans) of contaminated rows: character offsets of each run of hit words in the original text."""
    texts = with_row_id(docs.select(F.col(text_col).alias("text")))
    some = found.where(F.size("hits") > 0).select("rid", "hits")

    def run(batch: pa.RecordBatch):
        spans = []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
            raw = text.encode()
            flat = np.frombuffer(b" " + raw.translate(NORMAL) + b" ", np.uint8) != 32
            starts = np.flatnonzero(flat[1:] & ~flat[:-1])
            ends = np.flatnonzero(~flat[1:] & flat[:-1])
            hits = np.array(hits)
            cut = np.flatnonzero(np.diff(hits) != 1) + 1
            firsts, lasts = hits[np.concatenate([[0], cut])], hits[np.concatenate([cut - 1, [len(hits) - 1]])]
            spans.append([{"start": len(raw[:starts[a]].decode()), "end": len(raw[:ends[b]].decode())}
                          for a, b in zip(firsts, lasts)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(spans, kind)], names=["rid", "spans"])
    return map_slices(texts.join(some, "rid"), run, "rid bigint, spans array<struct<start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``decontaminate``."""
    return found.select("rid", "n_words", F.size("hits").cast("bigint").alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))
