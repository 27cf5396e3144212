"""Toxicity by noisy-channel deobfuscation.

A disguised word is a path through a character lattice: digits and signs may
stand for letters, a repeated letter may be one letter, signs may be padding,
and a gap between short pieces may be none.  Viterbi decoding finds the
likeliest letters under a character trigram model, whose counts come from all
documents.  The restored text is scored by a logistic model over restored words
and word beginnings, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import coded_words, map_slices, store

#: Labelled rows that the classifier is fitted on, at most (chosen by a hash of the id).
SAMPLE_ROWS = 20_000
#: Features looked at, and kept, when fitting.
CANDIDATES, FEATURES, LEAST_DOCS = 20_000, 300, 5

#: What signs may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
        "!": "il", "|": "il", "+": "t"}
#: Log-probabilities of the channel.
AS_SIGN, REPEATED, PADDING = -1.0, -0.5, -7.0
#: Of a gap that parts no words, where a piece of several letters is beside it; between single letters it is free.
GLUED = -1.0
PIECE = 3                          # letters of a piece set apart, at most
LETTERS = 28                       # 0: none (a word's edge), 1-26: a-z, 27: any other letter
BEGINNINGS = (4, 5, 6)             # letters of the word beginnings that are features
MEMORY = 60_000                    # readings of each kind that a task keeps, about
PART_BYTES = 4 << 20                # text whose words and features a task holds at a time
DOUBLES = 4                        # repeated letters of a word whose readings are weighed one by one
WINDOW = 256                       # longer words are decoded in pieces of this length
_CODE = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0
                  for b in range(256)], np.uint8)
_ODD = re.compile(r"[0-9@$!|+]|([^\W\d_])\1\1|[^\W_][^\w@$!|+]+[^\W_]")
_MAYBE = re.compile(r"[^\W_]_+[^\W_]|([^\W\d_])\1")           # the plain reading is as likely
_SIGNS = re.compile(r"[^\W\d_]")
_SPACED = re.compile(r"[^\w@$!|+]|_")


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed log P(c | a, b) for all letter triples, counted over every text."""
    def run(batch: pa.RecordBatch):
        texts = pc.fill_null(batch.column(text_col), "")
        raw = " ".join(texts.to_pylist()).encode()
        codes = _CODE[np.frombuffer(b"  " + raw + b"  ", np.uint8)].astype(np.int64)
        got = np.bincount(codes[:-2] * LETTERS ** 2 + codes[1:-1] * LETTERS + codes[2:], minlength=LETTERS ** 3)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["triple", "n"])
    rows = (map_slices(docs.select(text_col), run, "triple bigint, n bigint", by=text_col)
            .groupBy("triple").agg(F.sum("n").alias("n")).collect())   # at most LETTERS ** 3 rows
    counts = np.zeros(LETTERS ** 3)
    for r in rows:
        counts[r.triple] = r.n
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    tri[:, 0, 0] = 0                                                  # gaps say nothing of letters
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0) + 1
    back = (bi + 5 * uni / uni.sum()) / (bi.sum(axis=1, keepdims=True) + 5)
    return np.log((tri + 5 * back[None]) / (tri.sum(axis=2, keepdims=True) + 5))


def decode(words: list[str], model: np.ndarray) -> list[str]:
    """Viterbi decoding of disguised words (lower case), in groups of like length."""
    out: list[str] = [""] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for lo in range(0, len(order), 128):
        some = order[lo:lo + 128]
        for i, got in zip(some, _decode([words[i][:WINDOW] for i in some], model)):
            out[i] = got
    for i, w in enumerate(words):
        if len(w) > WINDOW:
            out[i] += "".join(decode([w[a:a + WINDOW] for a in range(WINDOW, len(w), WINDOW)], model))
    return out


def _decode(words: list[str], model: np.ndarray) -> list[str]:
    n, width = len(words), max(map(len, words))
    letter = np.full((2, n, width), -1)           # what each sign may stand for
    cost, skip = np.zeros((2, n, width)), np.full((n, width), -np.inf)
    for i, w in enumerate(words):
        for t, c in enumerate(w):
            if "a" <= c <= "z":
                letter[0, i, t] = ord(c) - 96
                if t and w[t - 1] == c:
                    skip[i, t] = REPEATED
            elif c in LEET:
                for k, x in enumerate(LEET[c]):
                    letter[k, i, t], cost[k, i, t] = ord(x) - 96, AS_SIGN
                skip[i, t] = REPEATED + AS_SIGN if t and w[t - 1] == c else PADDING
            elif c.isalpha():
                letter[0, i, t] = 27
            elif c == " ":
                letter[0, i, t], skip[i, t] = 0, _gap(w, t)
            else:
                skip[i, t] = 0.0
        skip[i, len(w):] = 0.0
    best = np.full((n, LETTERS, LETTERS), -np.inf)
    best[:, 0, 0] = 0
    by_last = np.ascontiguousarray(model.transpose(2, 0, 1))
    before = np.zeros((width, n, LETTERS, LETTERS), np.uint8)    # the letter before the pair; 255: skipped
    for t in range(width):
        now, came = best + skip[:, t, None, None], np.full(best.shape, 255, np.uint8)
        for k in range(2):
            who = np.flatnonzero(letter[k, :, t] >= 0)
            if not len(who):
                continue
            to = letter[k, who, t]
            path = best[who] + by_last[to]
            a = path.argmax(axis=1)
            value = np.take_along_axis(path, a[:, None], 1)[:, 0] + cost[k, who, t][:, None]
            old = now[who, :, to]
            now[who, :, to] = np.maximum(old, value)
            came[who, :, to] = np.where(value > old, a, came[who, :, to])
        best, before[t] = now, came
    final = (best + model[:, :, 0]).reshape(n, -1).argmax(axis=1)
    first, last = final // LETTERS, final % LETTERS
    said: list[list[str]] = [[] for _ in words]
    for t in range(width - 1, -1, -1):
        a = before[t, np.arange(n), first, last]
        for i in np.flatnonzero(a != 255).tolist():
            said[i].append(" " if last[i] == 0 else words[i][t] if last[i] == 27 else chr(96 + last[i]))
        first, last = np.where(a == 255, first, a), np.where(a == 255, last, first)
    return ["".join(reversed(x)) for x in said]


def once(words: list[str], model: np.ndarray) -> list[str]:
    """``decode`` for words whose only doubt is doubled letters: few letters may be repeats, so all readings are weighed.

    Words with other doubts, or over ``DOUBLES`` repeats, go through the whole lattice.
    """
    out: list[str | None] = [None] * len(words)
    alike: dict[tuple[int, int], list[int]] = {}
    other = []
    for i, w in enumerate(words):
        twice = sum(a == b for a, b in zip(w, w[1:]))
        if 0 < twice <= DOUBLES and len(w) <= WINDOW and w.isascii() and w.isalpha():
            alike.setdefault((len(w), twice), []).append(i)
        else:
            other.append(i)
    for i, got in zip(other, decode([words[i] for i in other], model)):
        out[i] = got
    for (width, twice), some in alike.items():
        text = np.frombuffer("".join([words[i] for i in some]).encode(), np.uint8).reshape(len(some), width)
        letter = text.astype(np.int64) - 96
        again = np.zeros(letter.shape, bool)
        again[:, 1:] = letter[:, 1:] == letter[:, :-1]
        which = np.where(again, np.cumsum(again, axis=1) - 1, 0)       # number of the repeat at its place
        best, chosen = np.full(len(some), -np.inf), np.zeros(len(some), np.int64)
        for dropped in range(1 << twice):                              # bit k: the k-th repeat is no letter
            gone = again & (dropped >> which & 1).astype(bool)
            total, a, b = np.zeros(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            for t in range(width):
                c, skip = letter[:, t], gone[:, t]
                total += np.where(skip, REPEATED, model[a, b, c])
                a, b = np.where(skip, a, b), np.where(skip, b, c)
            total += model[a, b, 0]
            better = total > best
            best, chosen = np.where(better, total, best), np.where(better, dropped, chosen)
        keep = ~(again & (chosen[:, None] >> which & 1).astype(bool))
        for i, x, k in zip(some, text, keep):
            out[i] = x[k].tobytes().decode()
    return out


def _gap(pieces: str, t: int) -> float:
    alone = pieces[max(t - 2, 0):t - 1] in ("", " ") and pieces[t + 2:t + 3] in ("", " ")
    return 0.0 if alone else GLUED


def unspaced(stretches: list[str], model: np.ndarray) -> list[str]:
    """Pieces of letters, a blank between two: blanks that part no words go.

    The lattice of ``decode`` where only the gaps are open: a letter follows either a letter or a word's edge.
    """
    out = [""] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
    for lo in range(0, len(order), 2048):
        some = order[lo:lo + 2048]
        for i, edges in zip(some, _edges([stretches[i] for i in some], model)):
            letters = stretches[i].replace(" ", "")
            cuts = [0, *np.flatnonzero(edges[1:len(letters)]) + 1, len(letters)]
            out[i] = " ".join([letters[a:b] for a, b in zip(cuts, cuts[1:])])
    return out


def _edges(stretches: list[str], model: np.ndarray) -> np.ndarray:
    """Whether a word begins with each letter."""
    n = len(stretches)
    size = np.array([len(s) - s.count(" ") for s in stretches])
    letter, gap = np.zeros((n, size.max()), np.int64), np.full((n, size.max()), np.nan)
    for i, s in enumerate(stretches):
        at = 0
        for t, c in enumerate(s):
            if c == " ":
                gap[i, at] = _gap(s, t)
            else:
                letter[i, at] = ord(c) - 96 if "a" <= c <= "z" else 27
                at += 1
    width = letter.shape[1]
    inner, edge = np.full(n, -np.inf), model[0, 0, letter[:, 0]]    # scores: a letter before the last one, or an edge
    came = np.zeros((2, width, n), bool)                          # from an edge
    ends = np.zeros(n, bool)
    for t in range(width):
        b, a = letter[:, t], letter[:, t - 1]
        last = size == t + 1
        ends[last] = (edge + model[0, b, 0] > inner + model[a, b, 0])[last]
        if t + 1 == width:
            break
        c, open_ = letter[:, t + 1], ~np.isnan(gap[:, t + 1])
        near, far = inner + model[a, b, c], edge + model[0, b, c]
        near0, far0 = inner + model[a, b, 0], edge + model[0, b, 0]
        came[0, t + 1], came[1, t + 1] = far > near, far0 > near0
        inner = np.maximum(near, far) + np.where(open_, gap[:, t + 1], 0)
        edge = np.where(open_, np.maximum(near0, far0) + model[b, 0, c], -np.inf)
    got, state = np.zeros((n, width), bool), np.zeros(n, bool)
    for t in range(width - 1, -1, -1):
        state = np.where(size == t + 1, ends, state)
        got[:, t] = state
        state = np.where(state, came[1, t], came[0, t])
    return got


def _stretches(words: list[str], bare: list[str], index: np.ndarray, text: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct runs of two or more short pieces, and (run, text) index pairs."""
    pieces = [w if len(w) == 1 else b for w, b in zip(words, bare)]
    short = np.fromiter((0 < len(p) <= PIECE and all(c.isalpha() or c in LEET for c in p) and (len(p) == 1 or bool(_SIGNS.search(p)))
                         for p in pieces), bool, len(pieces))[index]
    run = short[1:] & short[:-1] & (text[1:] == text[:-1])          # goes on with the next word
    edge = np.flatnonzero(np.diff(np.concatenate([[0], run, [0]]).astype(np.int8)))
    names: dict[str, int] = {}
    which, where = [], []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        which.append(names.setdefault(" ".join([pieces[i] for i in index[a:b + 1].tolist()]), len(names)))
        where.append(text[a])
    return list(names), np.array(which, np.int64), np.array(where, np.int64)


def _bare(words: list[str]) -> list[str]:
    """Words without the signs around them (three dollars at the end are signs)."""
    column = pc.utf8_rtrim(pc.utf8_ltrim(pa.array(words, pa.string()), ".,;:?\"'()[]{}%*&#-_~=<>¿¡«»"), ".,;:?!\"'()[]{}%*&#-_~=<>|«»")
    return [w[:-3].rstrip("$") if w.endswith("$$$") else w for w in column.to_pylist()]


def _remembered(memory: dict, words: list[str], model: np.ndarray, work) -> list[str]:
    """``work(words, model)``; ``memory`` holds what a task worked out last and only saves work."""
    held = memory.setdefault(work.__name__, {})
    if len(held) > MEMORY:
        held.clear()
    got = [held.get(w) for w in words]
    missing = [i for i, g in enumerate(got) if g is None]
    for i, g in zip(missing, work([words[i] for i in missing], model)):
        got[i] = held[words[i]] = g
    return got


def restored(texts: pa.Array, model: np.ndarray, memory: dict | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct restored words, and (word, text) index pairs of all their places."""
    memory = {} if memory is None else memory
    words, index, offsets = coded_words(pc.utf8_lower(pc.fill_null(texts, "")))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # Three or more single signs in a row may be one word set apart.
    alone = np.fromiter((len(w) == 1 and (w.isalpha() or w in LEET) for w in words), bool, len(words))[index]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alone, [0]])))
    apart = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= 3:
            cuts = [a, *(np.flatnonzero(np.diff(text[a:b])) + a + 1).tolist(), b]
            apart += [(x, y) for x, y in zip(cuts, cuts[1:]) if y - x >= 3]
    joined = ["".join([words[i] for i in index[x:y].tolist()]) for x, y in apart]
    bare = _bare(words)
    clean = bare + joined
    odd = [i for i, w in enumerate(clean) if _ODD.search(w) and _SIGNS.search(w)]
    for i, w in zip(odd, decode([_SPACED.sub("", clean[i]) for i in odd], model)):
        clean[i] = w
    whole = [(np.arange(len(words), len(clean)), text[[x for x, _ in apart]].astype(np.int64) if apart else np.empty(0, np.int64))]
    # Second readings, beside the plain one: underscores and doubled letters, and words of short pieces.
    done = set(odd)
    maybe = [i for i, w in enumerate(clean[:len(words)]) if i not in done and _MAYBE.search(w)]
    other = np.full(len(words), -1)
    for i, w in zip(maybe, _remembered(memory, [_SPACED.sub("", clean[i]) for i in maybe], model, once)):
        if w != clean[i]:
            other[i] = len(clean)
            clean.append(w)
    has = other[index] >= 0
    whole.append((other[index[has]], text[has]))
    runs, which, where = _stretches(words, bare, index, text)
    plain = [all(c == " " or c.isalpha() for c in r) and not _MAYBE.search(r) for r in runs]
    read = iter(_remembered(memory, [r for r, p in zip(runs, plain) if p], model, unspaced))
    signs = iter(_remembered(memory, [r for r, p in zip(runs, plain) if not p], model, decode))
    at, size, new = [], np.zeros(len(runs), np.int64), {}
    for i, (r, p) in enumerate(zip(runs, plain)):
        mine = set(next(read if p else signs).split()) - set(r.split())
        size[i] = len(mine)
        at += [new.setdefault(w, len(clean) + len(new)) for w in mine]
    clean += list(new)
    many = size[which]
    begin = (np.cumsum(size) - size)[which]
    spot = np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)
    whole.append((np.array(at, np.int64)[spot], np.repeat(where, many)))
    return clean, np.concatenate([index, *(i for i, _ in whole)]), np.concatenate([text, *(t for _, t in whole)])


def features(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)] if word else []


def _known_features(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """How many of the known features each word has, and these word by word."""
    column = pa.array(words, pa.string())
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    at, what = [], []
    for n in (None, *BEGINNINGS):
        wanted = {f if n is None else f[:-1]: i for f, i in known.items()
                  if n is None or (len(f) == n + 1 and f.endswith("*"))}
        value = column if n is None else pc.utf8_slice_codeunits(column, 0, n)
        found = pc.fill_null(pc.index_in(value, pa.array(list(wanted), pa.string())), -1).to_numpy(zero_copy_only=False)
        has = np.flatnonzero((found >= 0) & (length >= (n or 1)))
        at.append(has)
        what.append(np.array([*wanted.values(), 0], np.int64)[found[has]])
    at, what = np.concatenate(at), np.concatenate(what)
    order = np.argsort(at, kind="stable")
    return np.bincount(at, minlength=len(words)), what[order]


def _pairs(texts: pa.Array, model: np.ndarray, known: dict[str, int] | None, memory: dict | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Features present in each text: names, and distinct (feature, text) pairs; ``known`` only, if given."""
    words, index, text = restored(texts, model, memory)
    names: dict[str, int] = dict(known or {})
    if known is None:
        own = [[names.setdefault(f, len(names)) for f in features(w)] for w in words]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((f for x in own for f in x), np.int64, int(size.sum()))
    else:
        size, flat = _known_features(words, known)
        use = size[index] > 0
        index, text = index[use], text[use]
    which = np.unique(index * max(len(texts), 1) + text)           # each word once per text
    index, text = which // max(len(texts), 1), which % max(len(texts), 1)
    starts = np.cumsum(size) - size
    many = size[index]
    ends = np.cumsum(many)
    at = np.arange(int(many.sum())) + np.repeat(starts[index] - (ends - many), many)
    both = np.unique(flat[at] * max(len(texts), 1) + np.repeat(text, many))
    return list(names), both // max(len(texts), 1), both % max(len(texts), 1)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts with a 0/1 label whose crc32(id) mod 5 isn't 0; ``rows`` at most."""
    marked = (labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, model: np.ndarray) -> tuple[dict[str, float], float]:
    """Feature weights and intercept from (text, label) rows, a bounded sample.

    Features are chosen greedily by how many toxic texts they explain that no
    chosen one does, less the clean texts they occur in; so the other words of
    a much-copied toxic text add little.  Their weights are a logistic fit.
    """
    share = {int(r["label"]): int(r["n"]) for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = share.get(1, 0), share.get(0, 0)
    if not toxic or not clean:
        return {}, 0.0 if not toxic + clean else (-20.0 if not toxic else 20.0)

    def count(batch: pa.RecordBatch):
        names, which, text = _pairs(batch.column("text"), model, None)
        label = batch.column("label").to_numpy()[text]
        pos = np.bincount(which, label, len(names)).astype(np.int64)
        neg = np.bincount(which, 1 - label, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos), pa.array(neg)], names=["f", "pos", "neg"])
    seen = (map_slices(labelled.select("text", "label"), count, "f string, pos bigint, neg bigint", max_bytes=PART_BYTES)
            .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where((F.col("pos") >= min(LEAST_DOCS, toxic)) & (F.col("pos") * clean > F.col("neg") * 5 * toxic))
            .orderBy(F.desc("pos"), "neg", "f").limit(CANDIDATES).toPandas())
    if not len(seen):
        return {}, float(np.log(toxic / clean))

    def present(known):
        def run(batch: pa.RecordBatch):
            _, which, text = _pairs(batch.column("text"), model, known)
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(which[order], pa.int32()))],
                names=["label", "has"])
        return run
    known = {f: i for i, f in enumerate(seen["f"])}
    bad = labelled.where("label = 1").select("text", "label")
    rows = map_slices(bad, present(known), "label int, has array<int>", max_bytes=PART_BYTES).toPandas()["has"]
    holds = np.zeros((len(known), len(rows)), bool)
    for i, has in enumerate(rows):
        holds[np.asarray(has, np.int64), i] = True
    neg, left, chosen = seen["neg"].to_numpy() * 2.0, np.ones(len(rows), bool), []
    gain = holds.sum(axis=1) - neg
    while len(chosen) < FEATURES:
        at = int(gain.argmax())
        if gain[at] < min(LEAST_DOCS, toxic):
            break
        chosen.append(at)
        gone = holds[at] & left
        gain -= holds[:, gone].sum(axis=1)
        left &= ~holds[at]
        gain[at] = -np.inf
    names = seen["f"].iloc[chosen].tolist()
    if not names:
        return {}, float(np.log(toxic / clean))
    got: pd.DataFrame = map_slices(labelled.select("text", "label"), present({f: i for i, f in enumerate(names)}),
                                   "label int, has array<int>", max_bytes=PART_BYTES).toPandas()
    x = np.zeros((len(got), len(names) + 1))
    x[:, -1] = 1
    for i, has in enumerate(got["has"]):
        x[i, np.asarray(has, np.int64)] = 1
    y, w = got["label"].to_numpy(float), np.zeros(len(names) + 1)
    ridge = np.append(np.full(len(names), 0.3), 1e-6)
    for _ in range(30):                                            # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return dict(zip(names, w[:-1].tolist())), float(w[-1])


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on) for every row.

    Null and empty texts score as texts without any feature.  Without labels
    of both kinds all rows score alike (0.5 without any label, which counts as
    not toxic by a hair: 0.4999).  Repeated rows score alike; extra columns pass
    through, but one named score or predicted gives way to the result.
    """
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(columns)
    spark = docs.sparkSession
    model = character_model(docs)
    labelled = store(sample(docs, labels, sample_rows), "labelled")
    weights, bias = fit(labelled, model)
    if not weights and bias == 0.0:
        bias = -4e-4
    sent = spark.sparkContext.broadcast((model, list(weights), np.array([*weights.values(), 0.0])))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)

    memory: dict = {}                                              # each task gets a copy of its own

    def run(batch: pa.RecordBatch):
        model, names, weight = sent.value
        _, which, text = _pairs(batch.column("text"), model, {f: i for i, f in enumerate(names)}, memory)
        total = bias + np.bincount(text, weight[which], batch.num_rows)
        value = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                                         names=[*columns, "score", "predicted"])
    return map_slices(docs, run, f"{schema}, score double, predicted int", max_bytes=PART_BYTES)
