"""Periodic runs of words by recursive frequency splitting.

A run with period q is a longest stretch whose words q apart are identical,
q its smallest period, of at least two periods and ``least`` words.  So every
word of a run stands in it again at a distance of q, which is at most half of
the run.  A word without an equal one within half of the current segment's
length (before or after it, in the segment) can join no run there: it splits
the segment, and so do its pieces, until nothing changes.

The lag scan of what survives looks, for each lag q up to half the segment, at
every q-th word only: a run of two periods holds one of these together with
its partner q further.  How far both agree to the left and right is found by
halving steps over prefix hashes and then read off the words themselves, so a
hash never decides.  A segment of m words takes about m * ln(m) looks.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shortlist.llm.common import gather, map_slices, words_of

#: Looks of the lag scan made at a time: bounds scratch memory, not results.
LOOKS = 1 << 20

#: Two primes below 2^31 and a base: products of residues fit in 64 bits.
_PRIMES = (2147483647, 2147483629)
_BASE = 911382323


def _neighbours(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the same document's nearest equal word before and after (0: none)."""
    order = np.lexsort((ids, doc))   # stable: equal words stay in text order
    same = (ids[order][1:] == ids[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    gap = np.where(same, np.diff(order), 0)
    before, after = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    before[order[1:]] = gap
    after[order[:-1]] = gap
    return before, after


def split_segments(ids: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that no word splits any more.

    Stated for all documents of a slice at once; each round looks at the
    segments that changed in the one before.  Segments below ``least`` words go.
    """
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before, after = _neighbours(ids, doc)
    lo, hi = offsets[:-1], offsets[1:]
    done_lo, done_hi = [], []
    while True:
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        if not len(lo):
            break
        size = hi - lo
        at = gather(lo, size)
        start, end, half = (np.repeat(x, size) for x in (lo, hi, size // 2))
        b, a = before[at], after[at]
        joins = ((b > 0) & (b <= half) & (at - b >= start)) | ((a > 0) & (a <= half) & (at + a < end))
        first = np.cumsum(size) - size
        lost = np.add.reduceat((~joins).astype(np.int64), first)
        done_lo.append(lo[lost == 0])
        done_hi.append(hi[lost == 0])
        # Pieces between splitting words: stretches of joining words inside one segment.
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (joins[1:] != joins[:-1]) | (start[1:] != start[:-1])
        cut = np.flatnonzero(edge)
        piece = joins[cut[:-1]] & (np.repeat(lost, size)[cut[:-1]] > 0)
        lo, hi = at[cut[:-1]][piece], at[cut[1:] - 1][piece] + 1
    return np.concatenate([np.empty(0, np.int64), *done_lo]), np.concatenate([np.empty(0, np.int64), *done_hi])


class _Prefixes:
    """Prefix hashes of a word sequence, by which two stretches are compared."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for p in _PRIMES:
            power = np.ones(len(ids) + 1, np.int64)
            n = 1
            while n < len(power):     # doubling: base^(n+i) = base^n * base^i
                step = pow(_BASE, n, p)
                power[n:2 * n] = power[:len(power[n:2 * n])] * step % p
                n *= 2
            sums = np.zeros(len(ids) + 1, np.int64)
            np.cumsum((ids.astype(np.int64) + 1) * power[:-1] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(power)

    def equal(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``at`` equal those from ``at + lag`` (false alarms possible)."""
        same = np.ones(len(at), bool)
        for p, sums, power in zip(_PRIMES, self.sums, self.powers):
            one = (sums[at + size] - sums[at]) % p * power[lag] % p
            same &= one == (sums[at + lag + size] - sums[at + lag]) % p
        return same

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Greatest agreeing size, up to ``most``, from ``at`` on (or, with ``back``, ending before it)."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(at - mid if back else at, lag, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def lag_scan(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run in the given segments, by start and period.

    Lags come in octaves, small ones first.  A look inside a run that is known
    already, at a multiple of its period, can only find that run again and is
    left out, so long runs of one word cost no more than others.
    """
    prefixes = _Prefixes(ids)
    cover_end, cover_lag = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)
    found = [np.empty((0, 3), np.int64)]
    octave = 1
    while octave <= int((hi - lo).max(initial=0)) // 2:
        known = len(found)
        for at, lag, seg in _looks(lo, hi, octave):
            hit = (ids[at] == ids[at + lag]) & ((cover_end[at] <= at + lag) | (lag % cover_lag[at] != 0))
            found.append(_extend(ids, prefixes, at[hit], lag[hit], lo[seg[hit]], hi[seg[hit]], least))
        for s, e, q in np.concatenate(found[known:] or found[:1]).tolist():
            if e - s > 4 * q:
                longer = cover_end[s:e] < e
                cover_end[s:e][longer], cover_lag[s:e][longer] = e, q
        octave *= 2
    start, end, lag = np.concatenate(found).T
    # The same stretch under a multiple of its period: the smallest lag counts.
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, lag = start[new], end[new], lag[new]
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def _looks(lo: np.ndarray, hi: np.ndarray, octave: int):
    """(place, lag, segment) of the looks with lags from ``octave`` to twice that, at most LOOKS at a time."""
    halves = (hi - lo) // 2
    mine = np.flatnonzero(halves >= octave)
    many = np.minimum(halves[mine], 2 * octave - 1) - octave + 1
    segment = np.repeat(mine, many)
    lags = gather(np.full(len(mine), octave, np.int64), many)
    looks = (hi - lo)[segment] // lags - ((hi - lo)[segment] % lags == 0)   # both words lie in the segment
    ends = np.cumsum(looks)
    total = int(ends[-1]) if len(ends) else 0
    for first in range(0, total, LOOKS):
        n = np.arange(first, min(first + LOOKS, total))
        row = np.searchsorted(ends, n, side="right")
        lag, seg = lags[row], segment[row]
        yield lo[seg] + (n - (ends[row] - looks[row])) * lag, lag, seg


def _extend(ids, prefixes, at, lag, lo, hi, least):
    """(start, end, lag) of the stretches around the looks at ``at`` that are long enough, each once."""
    need = np.maximum(lag, least - lag)       # words that must agree with their partner
    part = (need + 1) // 2
    # One of both sides agrees on half of what is needed.
    fits = at + lag + part <= hi
    right = fits.copy()
    right[fits] = prefixes.equal(at[fits], lag[fits], part[fits])
    fits = (at - part >= lo) & ~right
    left = fits.copy()
    left[fits] = prefixes.equal(at[fits] - part[fits], lag[fits], part[fits])
    some = right | left
    at, lag, lo, hi, need = at[some], lag[some], lo[some], hi[some], need[some]
    start = at - prefixes.reach(at, lag, at - lo, back=True)
    end = at + prefixes.reach(at, lag, hi - lag - at)
    enough = end - start >= need
    start, end, lag, lo, hi = (x[enough] for x in (start, end, lag, lo, hi))
    key = np.lexsort((end, start, lag))       # several looks meet in one stretch
    start, end, lag, lo, hi = (x[key] for x in (start, end, lag, lo, hi))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (lag[1:] != lag[:-1])
    out = []
    for s, e, q, first, last in zip(*(x[new].tolist() for x in (start, end, lag, lo, hi))):
        if (ids[s:e] == ids[s + q:e + q]).all():
            out.append((s, e + q, q))
        else:                                 # a hash lied: this lag is read off the whole segment
            out += _stretches(ids, first, last, q, least)
    return np.array(out, np.int64).reshape(-1, 3)


def _stretches(ids, lo: int, hi: int, lag: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, lag) of every long enough stretch of one segment with one lag."""
    same = np.concatenate([[False], ids[lo:hi - lag] == ids[lo + lag:hi], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + lo
    edges = edges[edges[:, 1] - edges[:, 0] >= max(lag, least - lag)]
    return [(s, e + lag, lag) for s, e in edges.tolist()]


def replant(ids: np.ndarray, offsets: np.ndarray, names: list) -> np.ndarray:
    """Word numbers after the planted tails: where crc32(name) % 10 is 0, words repeat from a place on."""
    at = np.arange(len(ids))
    for d, name in enumerate(names):
        n = int(offsets[d + 1] - offsets[d])
        if name is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(name).encode()), 10)
        if rest == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[offsets[d] + a:offsets[d + 1]] = offsets[d] + a + np.arange(n - a) % p
    return at


def find_runs(ids: np.ndarray, offsets: np.ndarray, least: int = 12) -> tuple[np.ndarray, ...]:
    """(document, start, end, period) of every run, starts and ends as places in ``ids``."""
    start, end, period = lag_scan(ids, *split_segments(ids, offsets, least), least)
    return np.searchsorted(offsets, start, side="right") - 1, start, end, period


SCHEMA = ("id {id}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
          "runs_sha256 string, collapsed_text string, collapsed_sha256 string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12,
                  planted: bool = False, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs by start and period, their digest, the collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  The collapsed text keeps of each run its
    first period (words that another run drops go), joined by single spaces;
    with ``texts=False`` it is null and only its digest is given.  A null text
    has no words, a text without words no runs.  With ``planted``, documents
    with crc32(id) % 10 = 0 get a periodic tail first (ids null: none).  Rows
    may repeat; each stands for itself.  Extra columns are ignored.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())

    def run(batch: pa.RecordBatch):
        values, offsets = words_of(batch.column("text"))
        coded = values.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if planted:
            ids = ids[replant(ids, offsets, batch.column("id").to_pylist())]
        doc, start, end, period = find_runs(ids, offsets, least)
        drop = np.zeros(len(ids) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, end, -1)
        keep = np.cumsum(drop)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), coded.dictionary.take(pa.array(ids[keep]))), " ")
        first = np.searchsorted(doc, np.arange(len(offsets)))
        places = start - offsets[doc]
        line = [f"{s},{n},{q}\n" for s, n, q in zip(places.tolist(), (end - start).tolist(), period.tolist())]
        digests = [hashlib.sha256("".join(line[a:b]).encode()).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(places), pa.array(end - start), pa.array(period)], names=["start", "length", "period"]))
        collapsed = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(offsets)), runs, pa.array(digests),
             joined if texts else pa.nulls(len(batch), pa.string()), pa.array(collapsed)],
            names=["id", "n_words", "runs", "runs_sha256", "collapsed_text", "collapsed_sha256"])
    return map_slices(slim, run, schema)
