"""Exact substring dedup by difference-cover anchors.

Anchors are hashes of ``window - period + 1`` words at the positions whose
remainder modulo ``period`` is in a difference cover.  For any two positions
i and j some shift below ``period`` brings both onto the cover, so two equal
windows always share an aligned anchor.  Anchors seen once rule out most of
the text; around the others, the matches are extended to whole windows, whose
96-bit hashes decide.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import coded_words, map_slices, with_row_id, words_of

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Marks of a window's row: its text has copies; it stands for several places.
_COPIED, _MANY = 1 << 31, 1 << 30


def difference_cover(period: int) -> list[int]:
    """A smallest set whose differences give every remainder modulo ``period``."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    return [0]


def default_period(window: int) -> int:
    """Three fifths of the window: anchors stay long enough to be telling."""
    return max(1, min(window * 3 // 5, 31))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolled(hashes: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``length`` words, by doubling."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, piece, size, power = np.zeros(n, np.uint64), 0, hashes, 1, base
    while True:
        if length & size:
            out = out * power + piece[done:done + n]
            done += size
        if size * 2 > length:
            return out
        piece = piece[:len(piece) - size] * power + piece[size:]
        size, power = size * 2, np.uint64(int(power) ** 2 & (2 ** 64 - 1))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, index, offsets = coded_words(texts)
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return known[index], offsets


def _once_per_slice(rows: dict[str, np.ndarray], check: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Let one row of each key stand for its repeats in this slice.

    Repeats are known to be duplicates here; they get keys of their own and a
    weight of 2, and so spread over all tasks.  A key that fills the whole
    input therefore reaches the shuffle once per slice.
    """
    key = rows["key"]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if check is not None:
        same &= check[order][1:] == check[order][:-1]
    repeat = np.concatenate([[False], same])
    again = np.zeros(len(key), bool)
    again[order] = repeat | np.concatenate([same, [False]])
    extra = np.zeros(len(key), bool)
    extra[order] = repeat
    rows["weight"] = np.where(again, 2, rows["weight"]).astype(np.int32)
    spread = _mixed(key ^ _mixed((rows["rid"].view(np.uint64) << np.uint64(24)) + rows["pos"].view(np.uint32).astype(np.uint64)))
    rows["key"] = np.where(extra, spread, key)
    return rows


def _batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in rows.items()})


def anchors(texts: DataFrame, window: int, period: int) -> DataFrame:
    """(key, rid, pos) of every anchor of the texts (rid, text, copies).

    pos is negative (-1 - pos) where the row stands for several places: rows
    of few columns take less room in the shuffle.
    """
    cover, length = difference_cover(period), window - period + 1
    at_cover = np.isin(np.arange(period), cover)

    def run(batch: pa.RecordBatch):
        hashes, offsets = _word_hashes(batch.column("text"))
        if len(hashes) < window:
            return
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(hashes)) - offsets[:-1][doc]
        use = np.flatnonzero(at_cover[pos % period] & (pos + length <= sizes[doc]) & (sizes[doc] >= window))
        if not len(use):
            return
        rid = batch.column("rid").to_numpy()[doc[use]]
        weight = batch.column("copies").to_numpy()[doc[use]]
        rows = _once_per_slice({"key": _mixed(_rolled(hashes, length, _BASE)[use]), "rid": rid,
                                "pos": pos[use].astype(np.int32), "weight": np.minimum(weight, 2)})
        many = rows.pop("weight") > 1
        rows["pos"] = np.where(many, -1 - rows["pos"], rows["pos"]).astype(np.int32)
        yield _batch(rows)
    return map_slices(texts, run, "key bigint, rid bigint, pos int")


def windows(texts: DataFrame, window: int, period: int) -> DataFrame:
    """Whole windows around the shared anchors ``at`` of (rid, text, copies, at).

    Rows are (key, rid, tail): tail holds the second hash in its upper 32 bits,
    then the marks of ``_COPIED`` and ``_MANY``, then the position (a text of
    less than 2 GiB has less than 2 ** 30 words).  Texts with copies are there
    for others to match, and need no verdict themselves.
    """
    def run(batch: pa.RecordBatch):
        hashes, offsets = _word_hashes(batch.column("text"))
        if len(hashes) < window:
            return
        at = batch.column("at")
        count = np.diff(at.offsets.to_numpy())
        anchor = at.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(count)), count)
        sizes = np.diff(offsets)
        first = np.maximum(anchor - (period - 1), 0)
        last = np.minimum(anchor, sizes[doc] - window)
        ok = first <= last
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, offsets[:-1][doc[ok]] + first[ok], 1)
        np.add.at(edge, offsets[:-1][doc[ok]] + last[ok] + 1, -1)
        use = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(use):
            return
        doc = np.repeat(np.arange(len(sizes)), sizes)[use]
        pos = (use - offsets[:-1][doc]).astype(np.int32)
        copies = batch.column("copies").to_numpy()[doc]
        rid = batch.column("rid").to_numpy()[doc]
        check = (_mixed(_rolled(_mixed(hashes), window, _BASE2)[use]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        rows = _once_per_slice({"key": _mixed(_rolled(hashes, window, _BASE)[use]), "rid": rid, "pos": pos,
                                "weight": np.minimum(copies, 2)}, check)
        tail = (check.astype(np.int64) << 32) | rows["pos"]
        tail |= np.where(copies > 1, _COPIED, 0) | np.where(rows["weight"] > 1, _MANY, 0)
        yield _batch({"key": rows["key"], "rid": rows["rid"], "tail": tail})
    return map_slices(texts, run, "key bigint, rid bigint, tail bigint")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(rid, pos) of the anchors that stand at several places."""
    total = F.sum(F.when(F.col("pos") < 0, 2).otherwise(1)).over(Window.partitionBy("key"))
    place = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos"))
    return rows.withColumn("total", total).where("total > 1").select("rid", place.alias("pos"))


def shared_windows(rows: DataFrame) -> DataFrame:
    """(rid, pos) of the windows that stand at several places, without texts with copies.

    Rows are dealt by key, so that the second hash is unpacked after the shuffle.
    """
    def marked(bit):
        return F.col("tail").bitwiseAND(F.lit(bit)) != 0
    rows = rows.repartition("key").withColumn("check", F.shiftright("tail", 32))
    total = F.sum(F.when(marked(_MANY), 2).otherwise(1)).over(Window.partitionBy("key", "check"))
    pos = F.col("tail").bitwiseAND(F.lit(_MANY - 1)).cast("int")
    return rows.withColumn("total", total).where("total > 1").where(~marked(_COPIED)).select("rid", pos.alias("pos"))


def _kept(window: int, digest_only: bool):
    def run(batch: pa.RecordBatch):
        values, offsets = words_of(batch.column("text"))
        sizes = np.diff(offsets)
        edge = np.zeros(len(values) + 1, np.int64)
        at = batch.column("at")
        count = np.diff(at.offsets.to_numpy())
        pos = at.flatten().to_numpy().astype(np.int64) + np.repeat(offsets[:-1], count)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + window, -1)
        copied = (batch.column("copies").to_numpy() > 1) & (sizes >= window)
        gone = (np.cumsum(edge[:-1]) > 0) | np.repeat(copied, sizes)
        left = np.concatenate([[0], np.cumsum(~gone, dtype=np.int64)])[offsets]
        rest = values.filter(pa.array(~gone)).to_pylist()
        texts = [" ".join(rest[a:b]) for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
        out = {"rid": batch.column("rid"), "n_words": pa.array(sizes),
               "n_removed": pa.array(sizes - np.diff(left)),
               "kept_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())}
        yield pa.RecordBatch.from_pydict(out if digest_only else out | {"kept_text": pa.array(texts, pa.string())})
    return run


def substring_dedup(docs: DataFrame, window: int = 35, period: int | None = None,
                    text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """Per row of ``docs`` (a stored table): rid, n_words, n_removed, kept_sha256, kept_text.

    Removes every word covered by a window of ``window`` words that also starts
    anywhere else in the input, in the same text included.  Null and empty
    texts have no words; texts under ``window`` words stay whole; rows with the
    same text count as different places, so such a text goes entirely.  rid is
    the number that ``with_row_id`` gives.
    """
    period = period or default_period(window)
    rows = with_row_id(docs.select(F.col(text_col).alias("text")))
    texts = rows.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("rid", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"))
    classes = keyed.groupBy("same").agg(F.min("rid").alias("first"), F.count("*").alias("copies"))
    first = texts.join(classes.select(F.col("first").alias("rid"), F.least("copies", F.lit(2)).cast("int").alias("copies")), "rid")
    at = (shared_anchors(anchors(first, window, period))
          .groupBy("rid").agg(F.collect_list("pos").alias("at")))
    copies = keyed.join(classes, "same").select("rid", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    found = windows(texts.join(at.join(copies, "rid"), "rid"), window, period)
    marks = (shared_windows(found)
             .groupBy("rid").agg(F.collect_list("pos").alias("at")))
    none = F.array().cast("array<int>")
    judged = texts.join(copies.join(marks, "rid", "left")
                        .select("rid", "copies", F.coalesce("at", none).alias("at")), "rid")
    schema = "rid bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ("" if digest_only else ", kept_text string")
    return map_slices(judged, _kept(window, digest_only), schema)
