"""Token counts by a finite-state form of a sentencepiece BPE model.

BPE is a function of prefixes: the encoding of a prefix ends with one token,
and what stands before that token is itself encoded as if alone.  A state
therefore needs, for every suffix that may still grow into a piece, the token
before it and how many tokens lie before it, counted from the present.  Each
transition is annotated with the change of the token count, so a text's count
is the sum over its path.  States and transitions are compiled when a text
first takes them.

Texts are cut into chunks of ``CHUNK`` characters.  A space after another
character, and the start of a text, lead to one state from any state, so a
chunk's state map is constant behind the first such place; in front of it the
map depends on the state of entry.  All chunks run in lockstep: first the
constant parts, then the fronts, each from the entry states that can reach it.
A front's map starts with the state that the ``WARM`` characters before it
lead to, and gets the exits of the maps before it; these are few, as states
soon meet or recur.  The maps are composed by a parallel prefix scan: every (chunk,
entry) points to the next chunk at its exit, and pointers are doubled, so a
text of many chunks without a space takes logarithmically many steps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from shortlist.llm.common import map_slices, other_columns, per_worker

CHUNK = 128
#: Characters before a front that are run to guess its entry.
WARM = 48
#: Entry states of a front that guesses may add; those on the true path always count.
GUESSES = 32
#: Table entries (4 bytes each) kept before the compiled states are dropped and built anew.
TABLE_ENTRIES = 24_000_000
SPACE = "▁"
_START, _CLASS_SPACE = 0, 4


class Transducer:
    """Lazily compiled transitions: (state, class) -> next state and count change."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.stems = {p[:i] for p in self.score for i in range(1, len(p))}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces with an inner space are not supported")
        self.entries = entries
        # Classes 0-3: characters without a piece, by UTF-8 length; 4: the space.
        self.chars = [None] * 4 + [SPACE]
        lengths = np.zeros(0x110000, np.int16)
        lengths[0x80:], lengths[0x800:], lengths[0x10000:] = 1, 2, 3
        self.class_of = lengths
        for c in {c for p in self.score for c in p}:
            self.class_of[ord(c)] = -1          # has a piece; a class is given when first seen
        self.class_of[ord(SPACE)] = _CLASS_SPACE
        self.pairs: dict[tuple, bool] = {}
        self.width = 64
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.tuples: list[tuple] = []
        self.table = np.full(256 * self.width, -1, np.int32)
        self._state((("", None, 0),))

    def _state(self, key: tuple) -> int:
        if (found := self.states.get(key)) is None:
            found = self.states[key] = len(self.tuples)
            self.tuples.append(key)
            if (found + 1) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return found

    def classes(self, text: str) -> np.ndarray:
        """The class of every character, giving classes to new ones."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.class_of[codes]
        if (got < 0).any():
            for code in np.unique(codes[got < 0]).tolist():
                self.class_of[code] = len(self.chars)
                self.chars.append(chr(code))
            if len(self.chars) > self.width:
                old, rows = self.width, len(self.table) // self.width
                while len(self.chars) > self.width:
                    self.width *= 2
                wide = np.full((rows, self.width), -1, np.int32)
                wide[:, :old] = self.table.reshape(rows, old)
                self.table = wide.ravel()
            got = self.class_of[codes]
        return got

    def bpe(self, text: str) -> list[str]:
        """The pieces of a short string: best score first, then leftmost."""
        parts, after = list(text), list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        heap = []

        def push(i):
            if i >= 0 and after[i] < len(parts) and (s := self.score.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, len(parts[i]), len(parts[after[i]])))
        for i in range(len(parts)):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if len(parts[i]) != a or j >= len(parts) or len(parts[j]) != b:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p]

    def _fits(self, last: str | None, token: str) -> bool:
        """Whether ``token`` may follow the token ``last``."""
        key = (last, token)
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.bpe((last or "") + token) == ([token] if last is None else [last, token])
        return known

    def _compile(self, at: int) -> None:
        state, cls = divmod(at, self.width)
        key = self.tuples[state]
        if cls < 4:                                  # byte fallback: nothing joins across it
            after, change = _START, cls + 1
        else:
            char = self.chars[cls]
            if cls == _CLASS_SPACE and not (key[-1][1] or SPACE).endswith(SPACE):
                key = self.tuples[_START]            # nothing joins a space to what stands before it
            for stem, last, behind in key:
                token = stem + char
                if token in self.score and self._fits(last, token):
                    break
            change = behind + 1
            grown = tuple((s + char, t, k - change) for s, t, k in key if s + char in self.stems)
            after = self._state((*grown, ("", token, 0)))
        self.table[at] = after << 8 | change + 128

    def step(self, states: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and count changes; new states are compiled on the way."""
        got = self.table[states * self.width + cls]
        while (got < 0).any():
            for at in np.unique((states * self.width + cls)[got < 0]).tolist():
                self._compile(at)
            got = self.table[states * self.width + cls]
        return got >> 8, (got & 255) - 128

    def tidy(self) -> None:
        if len(self.tuples) * self.width > self.entries:
            self._clear()
        if len(self.pairs) > self.entries // 32:
            self.pairs.clear()

    def run(self, cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk ranges of ``cls`` in lockstep: exit states and counts."""
        states, counts = entry.astype(np.int64), np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        at, state, count = starts[order], states[order], counts[order]
        left = -lengths[order]
        for i in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(left, -i))      # ranges longer than i
            state[:n], change = self.step(state[:n], cls[at[:n] + i])
            count[:n] += change
        states[order], counts[order] = state, count
        return states, counts

    def _scan(self, cls: np.ndarray, starts: np.ndarray, body: np.ndarray, ends: np.ndarray, exits: np.ndarray,
              fronts: np.ndarray) -> np.ndarray:
        """Counts of the chunks' fronts: their maps over entry states, composed by pointer doubling.

        ``exits`` holds the exit state of every chunk that has a constant part.
        """
        rank = np.full(len(starts) + 1, -1)
        rank[fronts] = np.arange(len(fronts))
        sure = body[fronts - 1] < ends[fronts - 1]            # the chunk before ends in a known state
        onward = np.where(body[fronts] == ends[fronts], rank[fronts + 1], -1)   # a front that is its whole chunk feeds the next
        entry = exits[fronts - 1]
        warm = fronts[~sure]
        first = np.maximum(starts[warm] - WARM, starts[warm - 1])
        entry[~sure] = self.run(cls, first, starts[warm] - first, np.full(len(warm), _START))[0]
        chain = np.cumsum(np.concatenate([[0], onward[:-1] != np.arange(1, len(fronts))]))   # fronts that feed one another
        spread, reached = 1, 0
        front, state, exit_, count = np.arange(len(fronts)), entry, np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            new = np.arange(len(exit_), len(front))           # entries whose exit isn't known yet
            chunk = fronts[front[new]]
            out, more = self.run(cls, starts[chunk], body[chunk] - starts[chunk], state[new])
            exit_, count = np.concatenate([exit_, out]), np.concatenate([count, more])
            key = front << 32 | state
            order = np.argsort(key)
            wanted = onward[front] << 32 | exit_
            at = np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)
            there = key[order[at]] == wanted
            after = np.where((onward[front] >= 0) & there, order[at], -1)
            true, jump = np.zeros(len(front), bool), after
            true[:len(fronts)][sure] = True
            while (jump >= 0).any():                          # what the true entries lead to
                true[jump[true & (jump >= 0)]] = True
                jump = np.where(jump >= 0, jump[jump], -1)
            open_ = (onward[front] >= 0) & ~there
            if not (open_ & true).any():
                break
            many = np.bincount(front, minlength=len(fronts))
            # A state on the true path is tried at the next fronts too, at more of them as long as that helps.
            spread = spread * 2 if int(true.sum()) - reached >= spread else max(spread // 2, 1)
            reached = int(true.sum())
            lead = np.unique(wanted[open_ & true])
            far = ((lead >> 32)[:, None] + np.arange(spread)).ravel()
            ahead = np.repeat(lead & 0xFFFFFFFF, spread)
            near = far < len(fronts)
            near[near] = chain[far[near]] == np.repeat(chain[lead >> 32], spread)[near]
            more = np.concatenate([wanted[open_ & (true | (many[onward[front]] < GUESSES))], far[near] << 32 | ahead[near]])
            more = np.setdiff1d(more, key)
            front, state = np.concatenate([front, more >> 32]), np.concatenate([state, more & 0xFFFFFFFF])
        total = np.zeros(len(fronts), np.int64)
        total[front[true]] = count[true]
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        self.tidy()
        spelled = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        cls = self.classes("".join(spelled)).astype(np.int64)
        if not len(cls):
            return np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        chunks = -(-sizes // CHUNK)
        doc = np.repeat(np.arange(len(sizes)), chunks)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        starts = bounds[doc] + number * CHUNK
        ends = np.minimum(starts + CHUNK, bounds[doc + 1])
        # Where any state leads to one state: a space after another character, a text's start.
        reset = cls == _CLASS_SPACE
        reset[1:] &= cls[:-1] != _CLASS_SPACE
        reset[bounds[:-1][sizes > 0]] = True
        places = np.append(np.flatnonzero(reset), len(cls))
        body = np.minimum(places[np.searchsorted(places, starts)], ends)
        exits, counts = self.run(cls, body, ends - body, np.full(len(doc), _START))
        fronts = np.flatnonzero(body > starts)
        if len(fronts):
            counts[fronts] += self._scan(cls, starts, body, ends, exits, fronts)
        return np.bincount(doc, counts, len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_bytes, n_tokens and over_limit.

    Counts as the model's library does, without begin or end tokens.  Null
    texts count as empty: 0 bytes, 0 tokens.  Texts are counted whole, however
    long.  Extra columns pass through; one with the name of a result gives way.
    """
    rest = other_columns(docs, text_col, "n_bytes", "n_tokens", "over_limit")
    base = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)

    def run(batch: pa.RecordBatch):
        compiled = per_worker(("transducer", path), lambda: Transducer(path))
        texts = pc.fill_null(batch.column(text_col), "")
        size = pc.binary_length(texts).cast(pa.int64())
        count = pa.array(compiled.count(texts.to_pylist()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), size, count, pc.greater(count, limit)],
                                         names=[*rest, "n_bytes", "n_tokens", "over_limit"])
    return map_slices(docs, run, f"{base}n_bytes bigint, n_tokens bigint, over_limit boolean", by=text_col, max_bytes=2 << 20)
