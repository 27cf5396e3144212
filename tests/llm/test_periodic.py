"""Periodic runs against every lag at every place."""

import random

import brute
import numpy as np
import pytest
from test_operators import docs, empty, stored, texts  # noqa: F401 (fixtures)


def _sequences(rng, letters):
    out = []
    for _ in range(rng.randrange(1, 5)):
        w = [rng.randrange(letters) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randrange(1, 12)
            w = [x if i < a else w[a + (i - a) % p] if a + (i - a) % p < len(w) else 0 for i, x in enumerate(w)]
        out.append(w)
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 30])
@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_sequences(letters, least, monkeypatch):
    from shortlist.llm import periodic
    rng = random.Random(letters * 100 + least)
    for turn in range(30):
        monkeypatch.setattr(periodic, "LOOKS", rng.choice([7, 1 << 20]))
        if turn % 3 == 0:   # hashes that lie: every stretch must still be read off the words
            monkeypatch.setattr(periodic, "_PRIMES", (3, 5))
        seqs = _sequences(rng, letters)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in seqs])]).astype(np.int64)
        doc, start, end, period = periodic.find_runs(np.array(sum(seqs, []), np.int64), offsets, least)
        for d, w in enumerate(seqs):
            mine = doc == d
            got = list(zip((start[mine] - offsets[d]).tolist(), (end - start)[mine].tolist(), period[mine].tolist()))
            assert got == brute.runs(w, least)
        monkeypatch.undo()


def test_splitting_is_stable_and_loses_no_run():
    from shortlist.llm.periodic import split_segments
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(6) for _ in range(rng.randrange(12, 120))]
        lo, hi = split_segments(np.array(w, np.int64), np.array([0, len(w)]), 12)
        for s, n, _q in brute.runs(w):
            assert any(a <= s and s + n <= b for a, b in zip(lo, hi))
        for a, b in zip(lo.tolist(), hi.tolist()):
            for i in range(a, b):   # every word left has an equal one within half of its segment
                assert any(w[j] == w[i] for j in range(max(a, i - (b - a) // 2), min(b, i + (b - a) // 2 + 1)) if j != i)


def _rows():
    line = "the same old line of words again \n"
    return [*texts(), line * 40, "x " * 5000, "a b a b a b a b a b a b a b c", "u v w " * 4 + "u v x " * 4, "a a b " * 9 + "a a a " * 5,
            "Ä ö " * 30 + "ende", "one two\tthree\n" * 6]


def test_periodic_runs(spark, scratch):
    from shortlist.llm.periodic import periodic_runs
    rows = [(i, t, 7, "x") for i, t in enumerate(_rows())] + [(3, "one", 7, "x"), (None, "no id " * 9, 7, "x")]
    df = stored(spark, scratch, rows, "doc_id bigint, text string, runs int, id string", "runs")
    for planted in (False, True):
        got = periodic_runs(df, planted=planted).collect()
        key = lambda r: str(r)
        want = []
        for i, t, _, _ in rows:
            w = brute.planted_words(i, t) if planted else brute.words(t)
            found = brute.runs(w)
            gone = {k for s, n, q in found for k in range(s + q, s + n)}
            want.append((i, len(w), found, *brute.periodic(i, t, planted=planted)[5:],
                         " ".join(x for k, x in enumerate(w) if k not in gone)))
        have = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.runs_sha256, r.collapsed_sha256, r.collapsed_text) for r in got]
        assert sorted(have, key=key) == sorted(want, key=key)


def test_edge_tables(spark, docs, empty):  # noqa: F811
    from shortlist.llm.periodic import periodic_runs
    assert periodic_runs(docs).count() == docs.count()
    assert periodic_runs(empty).collect() == []


def test_query(spark, scratch):
    """The registered query on a whole small table, against brute force."""
    from shortlist.llm.queries import op13_periodic_runs
    rows = [(i, (t or "")[:4000] if t is not None else None) for i, t in enumerate(_rows() * 6)]
    stored(spark, scratch, rows, "doc_id bigint, text string", "documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, scratch).collect()}
    assert op13_periodic_runs(spark, scratch).columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got == {i: brute.periodic(i, t) for i, t in rows}
