"""BPE encoding and decoding with contiguous rank arrays.

Every distinct short word is a row of two contiguous arrays: its parts and the
merge ranks of adjacent parts.  Each round finds the least rank of every row,
deletes the boundary there, and refreshes the two neighbouring ranks; all words
of one length go through the rounds together.  Words over ``SHORT`` bytes keep
the same order of merges in a heap of adjacent pairs instead, since scanning a
long array again for each merge would take quadratic time.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from shortlist.llm.common import coded_words, gather, map_slices, other_columns, per_worker

SHORT = 256
_NONE = np.int32(2 ** 31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and word splitting read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.spelling = pa.array(self.tokens, pa.string())
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.end] for x in letters], np.int64)
        size = len(self.tokens)
        key = np.empty(len(model["merges"]), np.int64)
        new = np.empty(len(key), np.int64)
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            key[r], new[r] = vocab[a] * size + vocab[b], vocab[a + b]
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.ranks, self.merged = size, key[order], order.astype(np.int32), new
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # Letter classes and lower case beyond ASCII are those of the Unicode version the file's reader has.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(pattern), split["behavior"].lower(), split["invert"])
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    # ids -> text

    def decode(self, ids: np.ndarray, ends: list[int]) -> pa.Array:
        """Texts of the id sequences ``ids[ends[i]:ends[i + 1]]``: their tokens joined by spaces, as the file names no decoder."""
        spelled = self.spelling.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled), " ")

    # words -> pieces

    def pieces(self, word: str) -> list[str]:
        """Pieces of a normalised word."""
        if not word.isascii():
            return [piece for piece, _ in self.splitter.pre_tokenize_str(word)]
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def normal(self, word: str) -> str:
        return word.lower() if word.isascii() else self.normalizer.normalize_str(word)

    # pieces -> ids

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows of ``parts`` (words x bytes): parts and their number in each row."""
        n, width = parts.shape
        count = np.full(n, width)
        if width == 1:
            return parts, count
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.rank_of(parts[:, :-1], parts[:, 1:])
        live = np.arange(n)
        place = np.arange(width)
        while len(live):
            own = ranks[live]
            at = own.argmin(axis=1)
            least = own[np.arange(len(live)), at]
            go = least < _NONE
            live, at, least = live[go], at[go], least[go]
            if not len(live):
                break
            row = parts[live]
            mine = ranks[live]
            shift = place[None, :] > at[:, None]       # delete the boundary after ``at``
            moved = np.where(shift, np.roll(row, -1, axis=1), row)
            moved[np.arange(len(live)), at] = self.merged[least]
            later = np.where(place[None, :] >= at[:, None], np.roll(mine, -1, axis=1), mine)
            later[:, -1] = _NONE
            count[live] -= 1
            size, every = count[live], np.arange(len(live))
            left = np.flatnonzero(at > 0)              # refresh the neighbouring ranks
            later[left, at[left] - 1] = self.rank_of(moved[left, at[left] - 1], moved[left, at[left]])
            right = np.flatnonzero(at + 1 < size)
            later[right, at[right]] = self.rank_of(moved[right, at[right]], moved[right, at[right] + 1])
            ends = at + 1 >= size
            later[every[ends], at[ends]] = _NONE
            parts[live], ranks[live] = moved, later
        return parts, count

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.rank_of(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)

        def push(i):
            if i >= 0 and after[i] < n:
                a, b = parts[i], parts[after[i]]
                r = int(self.rank_of(np.array([a]), np.array([b]))[0])
                if r != _NONE:
                    heapq.heappush(heap, (r, i, a, b))
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [p for p, live in zip(parts, alive) if live]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each piece: flat ids, and each piece's start and length there."""
        raw = pa.array(pieces, pa.string())
        lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        starts, counts, flat, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        for width in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == width)
            step = max(1, (1 << 21) // max(width, 1))
            for lo in range(0, len(rows), step):
                some = rows[lo:lo + step]
                codes = data[at[some][:, None] + np.arange(width)]
                parts = self.inner[codes]
                parts[:, -1] = self.last[codes[:, -1]]
                if width > SHORT:
                    done = [self._long(p) for p in parts.tolist()]
                    count = np.array([len(x) for x in done])
                    ids = np.array([y for x in done for y in x])
                else:
                    parts, count = self._short(parts)
                    ids = parts[np.arange(width)[None, :] < count[:, None]]
                starts[some] = total + np.cumsum(count) - count
                counts[some] = count
                flat.append(ids)
                total += len(ids)
        return np.concatenate(flat) if flat else np.empty(0, np.int64), starts, counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each word between white space: flat ids, starts, lengths."""
        where: dict[str, int] = {}
        seq: list[int] = []
        size = np.empty(len(words), np.int64)
        fixed: dict[int, int] = {}
        for i, word in enumerate(words):
            parts = [word]
            if self.special is not None and "<" in word and self.special.search(word):
                parts, last = [], 0
                for m in self.special.finditer(word):
                    parts += [word[last:m.start()], m]
                    last = m.end()
                parts.append(word[last:])
            before = len(seq)
            for part in parts:
                if isinstance(part, str):
                    seq.extend([where.setdefault(p, len(where)) for p in self.pieces(self.normal(part))])
                else:
                    fixed[len(seq)] = self.specials[part.group()]
                    seq.append(-1)
            size[i] = len(seq) - before
        flat, starts, counts = self.encode_pieces(list(where))
        order = np.array(seq, np.int64)
        extra = np.array(sorted(fixed), np.int64)
        flat = np.concatenate([flat, [fixed[i] for i in extra.tolist()]]).astype(np.int64)
        own, many = starts[order] if len(starts) else np.zeros(len(order), np.int64), \
            counts[order] if len(counts) else np.zeros(len(order), np.int64)
        own[extra], many[extra] = len(flat) - len(extra) + np.arange(len(extra)), 1
        ids = flat[gather(own, many)]
        ends = np.concatenate([[0], np.cumsum(many)])
        edge = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[edge[:-1]], ends[edge[1:]] - ends[edge[:-1]]


def encode(docs: DataFrame, path: str, text_col: str = "text", digest: bool = False,
           decoded: bool = True) -> DataFrame:
    """``docs`` without its text, plus n_tokens, ids and decoded text (or digests of both).

    Texts are decoded from the ids of each document.  Null texts count as empty;
    empty texts have no ids and decode to "".  Very
    long texts and words are encoded whole.  Extra columns pass through; one
    with the name of a result gives way to it.
    """
    rest = other_columns(docs, text_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")))
    base = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    added = ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest
             else "n_tokens bigint, ids array<int>" + ", decoded string" * decoded)

    def run(batch: pa.RecordBatch):
        bpe = per_worker(("bpe", path), lambda: Bpe(path))
        words, index, offsets = coded_words(batch.column(text_col))
        flat, starts, lengths = bpe.encode_words(words)
        ids = flat[gather(starts[index], lengths[index])].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(lengths[index])])[offsets].tolist()
        texts = bpe.decode(ids, ends) if decoded else None
        spans = list(zip(ends[:-1], ends[1:]))
        count = pa.array([b - a for a, b in spans], pa.int64())
        if digest:
            raw = memoryview(ids).cast("B")
            more = [count, pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            more = [count, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))),
                    *([texts] if decoded else [])]
            names = ["n_tokens", "ids", *(["decoded"] if decoded else [])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *more], names=[*rest, *names])
    return map_slices(docs, run, f"{base}, {added}" if base else added, by=text_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids (null: empty)."""
    @F.pandas_udf("string")
    def spelled(ids):
        some = [[] if x is None else x for x in ids]
        ends = np.cumsum([0, *[len(x) for x in some]]).tolist()
        flat = np.concatenate(some) if ends[-1] else np.empty(0, np.int64)
        return per_worker(("bpe", path), lambda: Bpe(path)).decode(flat, ends).to_pandas()
    return encoded.withColumn("decoded", spelled(ids_col))
