"""Vocabulary containment for a vocabulary table of any size.

* A short vocabulary is tested entry by entry in the JVM.
* One that fits a broadcast goes to every task as a ``Scanner``: Arrow batches
  of lower-cased texts are scanned with numpy, position by position of the
  bytes, so a text costs the same however many entries there are.
* A larger one is joined in the JVM: an entry is contained in a text only if
  each of its q-grams is, so every entry is filed under one gram, the one that
  the fewest texts have; a text's distinct grams are joined with these, and
  ``contains`` verifies what meets.  Entries shorter than q are grams themselves.

In the first two cases texts cross no shuffle and a row's entries leave its
task as one array; arrays are grouped by key only where keys repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.text import SKILLS_SEPARATOR, extract_skills
from shortlist.session import materialize_if_possible

#: Longest gram.
Q = 4
#: Filed entries up to this many rows may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1 << 20
#: A vocabulary up to this many entries is tested entry by entry in the JVM.
LITERAL_ROWS = 100
#: One up to this many entries and characters is scanned for in the tasks.
SCAN_ROWS = 1 << 17
SCAN_CHARS = 1 << 24
#: Text positions looked at together, and flags (row, entry) held at a time.
SCAN_POSITIONS = 1 << 21
SCAN_FLAGS = 1 << 26


def _width(size: int) -> int:
    """Bytes of the grams that entries of this many bytes are filed under."""
    return 8 if size >= 8 else min(size, 4)


class Scanner:
    """Finds the entries contained in texts, all in UTF-8 bytes.

    Each entry is filed under one of its grams of ``_width`` bytes, one that
    few entries are filed under; where a text has that gram, the rest of the
    entry is compared in steps of the same width, the last one overlapping.
    """

    def __init__(self, entries: Sequence[str]):
        """``entries``: distinct, in code-point order."""
        self.entries = list(entries)
        raw = [e.encode() for e in self.entries]
        self.files = {}
        for width in sorted({_width(len(b)) for b in raw if b}):
            own = [i for i, b in enumerate(raw) if b and _width(len(b)) == width]
            used: dict[bytes, int] = {}
            for i in own:
                for g in {raw[i][o:o + width] for o in range(len(raw[i]) - width + 1)}:
                    used[g] = used.get(g, 0) + 1
            by_gram: dict[int, list[tuple[int, int]]] = {}
            for i in own:
                o = min(range(len(raw[i]) - width + 1), key=lambda o: (used[raw[i][o:o + width]], o))
                by_gram.setdefault(int.from_bytes(raw[i][o:o + width], "little"), []).append((i, o))
            grams = np.array(sorted(by_gram), np.uint64)
            filed = [x for g in sorted(by_gram) for x in by_gram[g]]
            count = np.array([len(by_gram[g]) for g in sorted(by_gram)])
            steps = [sorted({*range(0, len(raw[i]) - width, width), len(raw[i]) - width}) for i, _ in filed]
            bits = min(24, max(16, len(grams).bit_length() + 4))
            table = np.zeros(1 << bits, bool)
            table[self._slot(grams, bits)] = True
            self.files[width] = {
                "grams": grams, "count": count, "first": np.cumsum(count) - count, "bits": bits, "table": table,
                "entry": np.array([i for i, _ in filed]), "back": np.array([o for _, o in filed]),
                "size": np.array([len(raw[i]) for i, _ in filed]),
                "steps": np.array([len(x) for x in steps]), "step0": np.cumsum([0, *[len(x) for x in steps]])[:-1],
                "step": np.array([o for x in steps for o in x]),
                "code": np.array([int.from_bytes(raw[i][o:o + width], "little") for (i, _), x in zip(filed, steps) for o in x], np.uint64)}

    @staticmethod
    def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def _occurrences(self, codes: np.ndarray, width: int, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of occurrences whose gram starts at a position from ``lo`` to ``hi``; repeats included."""
        f = self.files[width]
        mask = np.uint64((1 << 8 * width) - 1)
        here = codes[lo:hi] & mask
        at = np.flatnonzero(f["table"][self._slot(here, f["bits"])])
        gram = np.minimum(np.searchsorted(f["grams"], here[at]), len(f["grams"]) - 1)
        same = f["grams"][gram] == here[at]
        at, gram = at[same] + lo, gram[same]
        many = f["count"][gram]
        total = np.cumsum(many)
        filed = np.repeat(f["first"][gram] - (total - many), many) + np.arange(total[-1] if len(total) else 0)
        row = np.repeat(np.searchsorted(ends, at, "right"), many)
        start = np.repeat(at, many) - f["back"][filed]
        begin = np.concatenate([[0], ends])[row]
        ok = (start >= begin) & (start + f["size"][filed] <= ends[row])
        filed, row, start = filed[ok], row[ok], start[ok]
        done_row, done_entry = [], []
        turn = 0
        while len(filed):
            step = f["step0"][filed] + turn
            ok = (codes[start + f["step"][step]] & mask) == f["code"][step]
            filed, row, start = filed[ok], row[ok], start[ok]
            turn += 1
            over = f["steps"][filed] == turn
            done_row.append(row[over])
            done_entry.append(f["entry"][filed[over]])
            filed, row, start = filed[~over], row[~over], start[~over]
        none = np.empty(0, np.int64)
        return np.concatenate(done_row or [none]), np.concatenate(done_entry or [none])

    def found(self, texts: pa.Array) -> pa.Array:
        """Entries of each text in code-point order (null: none)."""
        texts = texts.cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        given = texts.is_valid().to_numpy(zero_copy_only=False)
        n, size = len(self.entries), np.where(given, np.diff(edges), 0)
        every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        flat, counts = [], np.zeros(len(texts), np.int64)
        rows = max(1, SCAN_FLAGS // max(1, n))
        lo = 0
        while lo < len(texts):
            # Rows up to the flags at hand and, if more than one, the positions of one look.
            hi = min(len(texts), lo + rows, max(lo + 1, int(np.searchsorted(edges, edges[lo] + SCAN_POSITIONS, "right")) - 1))
            part = every[edges[lo]:edges[hi]]
            ends = edges[lo + 1:hi + 1] - edges[lo]
            codes = np.ndarray(len(part), "<u8", np.concatenate([part, np.zeros(8, np.uint8)]), 0, (1,))
            hit = np.zeros((hi - lo, n), bool)
            if n and not self.entries[0]:
                hit[:, 0] = True
            for at in range(0, len(part), SCAN_POSITIONS):
                for width in self.files:
                    hit[self._occurrences(codes, width, ends, at, min(at + SCAN_POSITIONS, len(part)))] = True
            hit[~given[lo:hi]] = False
            row, entry = np.nonzero(hit)
            counts[lo:hi] = np.bincount(row, minlength=hi - lo)
            flat.append(entry)
            lo = hi
        values = pa.array(self.entries, pa.string()).take(pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct overlapping substrings of the given lengths (in code points)."""
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{int(n)}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])


def _filed(lowered: DataFrame, entries: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(gram, skill): each entry under its rarest gram over all texts (ties: the smallest gram)."""
    size = F.least(F.length("skill"), F.lit(Q))
    options = F.coalesce(*[F.when(size == n, grams(F.col("skill"), [n])) for n in sizes])
    own = entries.select("skill", F.explode(options).alias("gram"))
    wanted = own.select("gram").distinct()
    wanted = F.broadcast(wanted) if entries.count() * Q <= BROADCAST_ROWS else wanted
    seen = lowered.select(F.explode(grams(F.col("_low"), sizes)).alias("gram")).join(wanted, "gram", "left_semi")
    counts = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rated = own.join(counts, "gram", "left").groupBy("skill").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best"))
    # An entry with a gram that no text has is in no text.
    return rated.where("best.texts > 0").select(F.col("best.gram").alias("gram"), "skill")


def _entries(vocabulary: DataFrame, entry_col: str) -> DataFrame:
    return materialize_if_possible(
        vocabulary.select(F.col(entry_col).alias("skill")).where("skill IS NOT NULL").distinct(), "vocabulary")


def _per_row(docs: DataFrame, entries: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame | None:
    """(keys, skills) of every row: its entries in code-point order; None if the vocabulary is too large for a task."""
    n, chars = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("skill")), F.lit(0))).first()
    if n > min(SCAN_ROWS, BROADCAST_ROWS) or chars > SCAN_CHARS:
        return None
    known = sorted(r[0] for r in entries.collect())
    lowered = docs.select(*keys, F.lower(F.col(text_col)).alias("_low"))
    if n <= LITERAL_ROWS:
        skills = F.when(F.col("_low").isNotNull(), extract_skills("_low", known, lowered="_low"))
        return lowered.select(*keys, F.coalesce(skills, F.array().cast("array<string>")).alias("skills"))
    scanner = Scanner(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), scanner.found(batch.column("_low"))],
                                             names=[*keys, "skills"])
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return lowered.mapInArrow(scan, f"{fields}, skills array<string>")


def _repeats(docs: DataFrame, keys: Sequence[str]) -> bool:
    return not docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def vocabulary_matches(docs: DataFrame, vocabulary: DataFrame, keys: Sequence[str], text_col: str = "raw_text",
                       entry_col: str = "skill") -> DataFrame:
    """(keys, skill): the vocabulary entries contained in each lower-cased text, each once per key.

    Entries are taken as they are (an upper-case letter is in no lower-cased
    text), repeated and null ones once or not at all; the empty entry is in
    every text that is not null.  ``keys`` should be unique; rows that share
    them count as one.
    """
    entries = _entries(vocabulary, entry_col)
    per_row = _per_row(docs, entries, keys, text_col)
    if per_row is None:
        return _joined_matches(docs, entries, keys, text_col)
    # ``explode`` would add a filter on the array's size that works the array out once more.
    out = per_row.select(*keys, F.explode_outer("skills").alias("skill")).where("skill IS NOT NULL")
    return out.distinct() if _repeats(docs, keys) else out


def _joined_matches(docs: DataFrame, entries: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``vocabulary_matches`` for a vocabulary of any size."""
    sizes = [r[0] for r in entries.select(F.least(F.length("skill"), F.lit(Q)).alias("n")).distinct().collect()]  # at most Q + 1
    lowered = docs.where(F.col(text_col).isNotNull()).select(*keys, F.lower(F.col(text_col)).alias("_low"))
    parts = [lowered.select(*keys, F.lit("").alias("skill"))] if 0 in sizes else []
    if some := sorted(n for n in sizes if n):
        filed = materialize_if_possible(_filed(lowered, entries.where("skill <> ''"), some), "filed")
        met = lowered.withColumn("gram", F.explode(grams(F.col("_low"), some)))
        if filed.count() <= BROADCAST_ROWS:
            found = met.join(F.broadcast(filed), "gram").where(F.contains("_low", "skill")).select(*keys, "skill")
        else:
            pairs = met.select(*keys, "gram").join(filed, "gram").select(*keys, "skill")
            found = pairs.join(lowered, list(keys)).where(F.contains("_low", "skill")).select(*keys, "skill")
        parts.append(found)
    if not parts:
        return lowered.select(*keys, F.lit("").alias("skill")).limit(0)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.distinct()


def skills_by_vocabulary(docs: DataFrame, vocabulary: DataFrame, keys: Sequence[str], text_col: str = "raw_text",
                         entry_col: str = "skill") -> DataFrame:
    """(keys, skills, Skills_List) of every document: its entries in code-point order, as an array and as text."""
    entries = _entries(vocabulary, entry_col)
    found = _per_row(docs, entries, keys, text_col)
    if found is None:
        sets = _joined_matches(docs, entries, keys, text_col).groupBy(*keys).agg(F.sort_array(F.collect_set("skill")).alias("skills"))
        found = docs.select(*keys).distinct().join(sets, list(keys), "left").withColumn(
            "skills", F.coalesce("skills", F.array().cast("array<string>")))
    elif _repeats(docs, keys):
        found = found.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("skills")))).alias("skills"))
    return found.withColumn("Skills_List", F.array_join("skills", SKILLS_SEPARATOR))
