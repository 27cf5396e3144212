"""Each operator against a plain version, on small inputs with awkward rows."""

import hashlib
import random
import struct
import zlib

import brute
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def stored(spark, scratch, rows, schema, name="t", parts=3):
    path = f"{scratch}/{name}"
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def texts():
    rng = random.Random(5)
    some = [f"w{rng.randrange(40)}" for _ in range(90)]
    passage = " ".join(f"p{i}" for i in range(12))
    return [None, "", "   \t\n", "one", "Über ΣΑΣ naïve x İstanbul é <|endoftext|> it's 12,5 'll", " ".join(some), " ".join(some),
            "same " * 60, "same same", f"a b {passage} c", f"d\n{passage}\te  f", "x" * 3000, " ".join(some[:40]) + " tail",
            "中文 テスト 😀 ‍ ſ", "  two  spaces   three ", "A.B-c A.b,C", " ".join(f"long{i}" for i in range(5000))]


@pytest.fixture()
def docs(spark, scratch):
    """Repeated rows, a null id, and extra columns whose names the operators use themselves."""
    rows = [(i, t, 7, "x") for i, t in enumerate(texts())] + [(3, "one", 7, "x"), (None, "no id", 7, "x")]
    return stored(spark, scratch, rows, "doc_id bigint, text string, rid int, fp string", "docs")


@pytest.fixture()
def empty(spark, scratch):
    return stored(spark, scratch, [], "doc_id bigint, text string", "empty", 1)


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def with_ids(docs, got):
    from shortlist.llm.common import with_row_id
    return with_row_id(docs.select("doc_id", "text")).join(got, "rid").collect()


def test_row_ids_of_any_split(spark, scratch):
    """The rows keep their numbers when a scan is split otherwise, as after a lost executor."""
    from shortlist.llm.common import with_row_id
    data = stored(spark, scratch, [(i, "x" * (i % 90)) for i in range(3000)], "doc_id bigint, text string", "a table", 7)
    seen = []
    for split in ("1", "3", "40"):
        spark.conf.set("spark.sql.files.minPartitionNum", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            seen.append({r.doc_id: r.rid for r in with_row_id(data.select("doc_id")).collect()})
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == 3000


@pytest.mark.parametrize("window", [1, 5, 12, 35])
def test_substring(docs, empty, window):
    from shortlist.llm.substring import substring_dedup
    rows = with_ids(docs, substring_dedup(docs, window))
    want = brute.substring([r.text for r in rows], window)
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert len(rows) == docs.count() and substring_dedup(empty, window).collect() == []


@pytest.mark.parametrize("period", range(1, 32))
def test_difference_cover(period):
    from shortlist.llm.substring import difference_cover
    cover = difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_simhash(docs, empty):
    from shortlist.llm.simhash import near_duplicates
    for bits in (0, 4):
        rows = near_duplicates(docs, shingle=4, max_bits=bits).collect()
        by_rid = {r.rid: r for r in rows}
        text = {r.rid: r.text for r in with_ids(docs, near_duplicates(docs).select("rid"))}
        assert len(rows) == len(by_rid) == docs.count()
        fps = [brute.simhash(text[r.rid]) for r in rows]
        assert [r.fp % 2 ** 64 for r in rows] == fps
        ids = [10 ** 9 if r.id is None else r.id for r in rows]
        want = [None if c == 10 ** 9 else c for c in brute.components(ids, fps, bits)]
        assert [r.component_id for r in rows] == want
        kept = [r.component_id for r in rows if r.keep]
        assert len(kept) == len(set(want)) and all(r.id == r.component_id for r in rows if r.keep)
    assert near_duplicates(empty).collect() == []


def test_simhash_large_cells(spark):
    """Chains and dense groups, with cells split into blocks."""
    from shortlist.llm.simhash import connected, links
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:3].tolist():
        chain = b
        for _ in range(60):
            fps.add(b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
            chain ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.add(chain)
    fps = sorted(fps)
    points = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    want = brute.components(list(range(len(fps))), fps, 4)
    for block in (16, 4096):
        got = {r.node % 2 ** 64: r.root % 2 ** 64 for r in connected(links(points, 4, block)).collect()}
        groups = {}
        for f, w in zip(fps, want):
            groups.setdefault(w, set()).add(got.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_decontaminate(spark, scratch, docs, empty):
    from shortlist.llm.decontam import decontaminate, digest, hit_spans
    passage = " ".join(f"P{i}" for i in range(12))
    items = [(1, passage, 0), (2, "ONE", 0), (3, None, 0), (4, " .,", 0), (2, "one", 0), (None, "two spaces", 0), (10, passage, 0)]
    bench = stored(spark, scratch, items, "item_id bigint, text string, hits int", "bench", 1)
    for block in (8 << 20, 64):
        found = decontaminate(docs, bench, 10, block_bytes=block)
        rows = with_ids(docs, found)
        want = brute.decontaminate([r.text for r in rows], [(i, t) for i, t, _ in items], 10)
        assert [(r.n_words, r.hits, r["items"]) for r in rows] == want
    assert any(h for _, h, _ in want) and digest(found).where("contaminated").count() == sum(bool(h) for _, h, _ in want)
    spans = {r.rid: r.spans for r in hit_spans(docs, found).collect()}
    for r in rows:
        for s in spans.get(r.rid, []):
            assert brute.normal_words(r.text[s.start:s.end]) and r.text[s.start:s.end].strip() == r.text[s.start:s.end]
    assert decontaminate(empty, bench).collect() == []
    none = decontaminate(docs, bench.where("false"))
    assert none.where(F.size("hits") > 0).count() == 0 and none.count() == docs.count()


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD_BPE)


def test_bpe(docs, empty):
    from shortlist.llm.bpe import decode, encode
    lib = library()
    rows = encode(docs, WORD_BPE).collect()
    assert len(rows) == docs.count() and rows[0].rid == 7
    text = dict(plain(docs))
    for r in rows:
        want = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(want), want, lib.decode(want, skip_special_tokens=False))
    short = encode(docs.select("doc_id", "text"), WORD_BPE, decoded=False)
    assert {r.doc_id: r.decoded for r in decode(short, WORD_BPE).collect()} == {r.doc_id: r.decoded for r in rows}
    for r in encode(docs, WORD_BPE, digest=True).collect():
        ids = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert encode(empty, WORD_BPE).collect() == []


def test_pipeline_bpe_encodes_and_decodes(spark):
    import corpus_pipeline
    from shortlist.llm.bpe import Bpe
    texts = ["Hello, World! naïve 中文", "", None, " a\tb  <|endoftext|>x ", "ab" * 400, "\x00 \x00z"]
    docs = spark.createDataFrame([(i, "en", "web", t) for i, t in enumerate(texts)], "doc_id bigint, lang string, source string, text string")
    lib = library()
    for r in corpus_pipeline.bpe(spark, docs, SF).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, lib.decode(ids, skip_special_tokens=False))
    from shortlist.llm.bpe import encode
    for r in encode(docs, WORD_BPE, digest=True).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    # Any id sequence decodes, also one that no text encodes to.
    bpe, ids = Bpe(WORD_BPE), [5, 0, 49151 % lib.get_vocab_size(), 5, 300, 1]
    got = bpe.decode(np.array(ids), [0, 4, 4, 6]).to_pylist()
    assert got == [lib.decode(x, skip_special_tokens=False) for x in (ids[:4], [], ids[4:])]


def test_bpe_random_words():
    from shortlist.llm.bpe import Bpe
    lib, bpe, rng = library(), Bpe(WORD_BPE), random.Random(1)
    letters = "abcdetion'sßéñ中😀.,!?12<|>_-ΣǺ 　İ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words += ["ab" * 400, "the" * 200, "<|endoftext|>", "x<|startoftext|>y<|endoftext|>"]
    flat, starts, lengths = bpe.encode_words(words)
    for w, s, n in zip(words, starts, lengths):
        assert flat[s:s + n].tolist() == lib.encode(w, add_special_tokens=False).ids, w


def test_bpe_of_every_code_point():
    """Alone, after a letter, and between letters: letter classes and lower case as the library has them."""
    from shortlist.llm.bpe import Bpe
    lib, bpe = library(), Bpe(WORD_BPE)
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    for lo in range(0, len(points), 1 << 15):
        words = [w for c in points[lo:lo + (1 << 15)] for w in ((c, f"a{c}e", f"x{c}") if c.isprintable() or ord(c) % 7 == 0 else (f"a{c}e",))]
        flat, starts, lengths = bpe.encode_words(words)
        want = lib.encode_batch(words, add_special_tokens=False)
        wrong = [w for w, s, n, e in zip(words, starts.tolist(), lengths.tolist(), want) if flat[s:s + n].tolist() != e.ids]
        assert not wrong, wrong[:10]


def test_token_counts(docs, empty):
    from sentencepiece import SentencePieceProcessor

    from shortlist.llm.tokencount import count_tokens
    lib, text = SentencePieceProcessor(model_file=PIECES), dict(plain(docs))
    rows = count_tokens(docs, PIECES, limit=50).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = text[r.doc_id] or ""
        n = len(lib.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 50)
    assert count_tokens(empty, PIECES).collect() == []


def test_transducer_random_texts():
    from sentencepiece import SentencePieceProcessor

    from shortlist.llm.tokencount import Transducer
    lib, rng = SentencePieceProcessor(model_file=PIECES), random.Random(2)
    letters = "abtheion  ▁\n\té中😀‍xyz09.,!́ſ"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 500))) for _ in range(600)]
    some += [" " * k for k in range(40)] + ["a" * 1000 + " " * 37 + "b" * 777]
    want = [len(x) for x in lib.encode(some)]
    small = Transducer(PIECES, entries=1000)             # dropped and compiled anew for every call
    assert Transducer(PIECES).count(some).tolist() == want
    assert [int(n) for lo in range(0, len(some), 50) for n in small.count(some[lo:lo + 50])] == want


def test_direct_codes(docs, empty):
    from shortlist.llm.dac import read_ids, write_ids
    lib = library()
    files = write_ids(docs, WORD_BPE, end_id=2, file_ids=500)
    rows = sorted(read_ids(files).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted([i for i, _ in plain(docs)], key=lambda i: (i is not None, i or 0))
    text, at = dict(plain(docs)), 0
    for r in rows:
        want = lib.encode(text[r.id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        at += len(want)
    crc = {(r.id, r.start): r.ids_crc32 for r in read_ids(files, digest=True).collect()}
    assert all(crc[r.id, r.start] == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in rows)
    assert read_ids(write_ids(empty, WORD_BPE, end_id=2)).collect() == []


def test_direct_codes_random_access():
    from shortlist.llm.dac import Reader, pack
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 10), (5000, 200), (5000, 60_000), (3000, 2 ** 32)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        reader = Reader(pack(ids, np.array([0, n // 2, n])))
        places = rng.integers(0, n, 500) if n else np.empty(0, np.int64)
        assert (reader.get(places) == ids[places]).all() and (reader.document(1) == ids[n // 2:]).all()


def test_direct_codes_spans():
    from shortlist.llm.dac import Reader, pack
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 300), (700, 200), (5000, 60_000), (3000, 2 ** 32)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        reader = Reader(pack(ids, np.array([0, n])))
        for lo, hi in [(0, n), (n, n), *np.sort(rng.integers(0, n + 1, (200, 2))).tolist()]:
            assert (reader.span(lo, hi) == ids[lo:hi]).all()


def test_direct_codes_pieces():
    """The library's model sees a piece once, whatever its case and the marks around it; all words are as the library has them."""
    from shortlist.llm.dac import LibraryIds
    lib, rng = library(), random.Random(3)

    def same(encode, words):
        flat, starts, lengths = encode(words)
        got = lib.encode(words, is_pretokenized=True, add_special_tokens=False)
        assert lengths.tolist() == np.bincount(got.word_ids, minlength=len(words)).tolist()
        assert [i for s, n in zip(starts.tolist(), lengths.tolist()) for i in flat[s:s + n].tolist()] == got.ids
    encode = LibraryIds(WORD_BPE)
    stems = [f"st{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(60)]
    same(encode, [a + case(w) + b for w in stems for case in (str, str.upper, str.title) for a in ("", "(", "7") for b in ("", ".", "!!", ",9")])
    assert len(encode.known) <= len(stems) + 10
    same(encode, [w for c in range(0, 0x3100) if chr(c) not in " \t\n\v\f\r" for w in (chr(c), f"aB{chr(c)}a", f"1{chr(c)}2", f"!{chr(c)}!", f"{chr(c)}\u0301x")])
    letters = [*"abXYsTlL019'!.<|", "é", "İ", "\u0301", "中", "²", "\u00a0", "\u2003", "\x1c", "\x00", "ﬁ", "ᄀ", "ᅡ", "Σ", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>"]
    small = LibraryIds(WORD_BPE, keep=500)               # dropped and gathered anew
    for _ in range(10):
        some = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(1500)]
        same(encode, some)
        same(small, some)
    same(encode, ["a" * 5000, "1" * 5000, "é!" * 2000, "x"])
    assert [len(x) for x in encode([])] == [0, 0, 0]


def test_warc(spark, scratch):
    from shortlist.llm.warc import assemble, read_records, write_captures
    evil = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    rows = [(5, "http://a/5", "same", 1), (3, "http://a/3", "same", 1), (4, None, None, 1), (7, "u", "", 1), (8, "u\r\nX: y", evil, 1),
            (9, "ü", "é" * 100_000, 1), (3, "http://a/3", "same", 1), (None, "n", "same", 1)]
    pages = stored(spark, scratch, rows, "page_id bigint, url string, html string, capture int", "pages")
    for least in (0, 1):
        records = read_records(write_captures(pages, min_bytes=least))
        assert records.count() == 3 * len(rows)
        got = assemble(records).collect()
        assert len(got) == len(rows) and all(len(r.requests) == len(r.metadata) == 1 for r in got)
        page = {r.record_id: r.metadata[0].fields.get("page-id") for r in got}
        for r in got:
            c = r.capture
            if c.type == "response":
                texts = {(h or "").encode() for i, _, h, _ in rows if str(i) == page[r.record_id] or i is None and page[r.record_id] is None}
                assert bytes(c.payload) in texts and c.payload_bytes == len(c.payload)
            else:
                assert c.payload is None and c.payload_bytes >= least
        same = sorted((page[r.record_id] or "", r.capture.type, page.get(r.capture.refers_to)) for r in got if r.capture.payload_bytes == 4)
        assert same == [("", "revisit", "3"), ("3", "response", None), ("3", "revisit", "3"), ("5", "revisit", "3")]
        nothing = sorted((page[r.record_id], r.capture.type) for r in got if r.capture.payload_bytes == 0)
        assert nothing == [("4", "response"), ("7", "response" if least else "revisit")]
    assert assemble(read_records(write_captures(stored(spark, scratch, [], "page_id bigint, url string, html string", "none", 1)))).collect() == []


def test_assemble_lone_records(spark):
    from shortlist.llm.warc import RECORD, assemble
    none = [None] * 6
    rows = [("f", 0, "r1", "response", *none), ("f", 1, "q1", "request", "r1", *none[1:]), ("f", 2, "q2", "request", "gone", *none[1:]),
            ("f", 3, "m", "metadata", *none), ("f", 4, None, "response", *none), ("f", 5, "q3", "request", "r1", *none[1:])]
    got = {r.record_id: ([x.record_id for x in r.requests], r.metadata) for r in assemble(spark.createDataFrame(rows, RECORD)).collect()}
    assert got[None] == ([], []) and sorted(got["r1"][0]) == ["q1", "q3"] and len(got) == 2


def test_chat(spark):
    from shortlist.llm.chat import rotate
    rows = [(1, 0, "system", "be kind", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", "naïve 😀", 0), (1, 3, "ann", None, 0), (1, 3, "ann", None, 0),
            (1, 300, "bob", "late", 0), (2, 0, "system", "alone", 0), (3, None, None, "who", 0), (None, 1, "ann", "x", 0), (None, 0, "cy", "", 0)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, block int")
    got = rotate(turns).collect()
    assert len(got) == 6 * 2 + 1 + 2 * 2
    for key in {(r.conv_id, r.perspective) for r in got}:
        line = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.seq)
        whole = "".join(r.rendered for r in line)
        assert [r.seq for r in line] == list(range(1, len(line) + 1))
        for r in line:
            assert whole[r.char_start:r.char_end] == r.rendered
            assert (r.chat_role == "assistant") == (r.loss_start is not None) and (r.name is None) == (r.chat_role != "user")
            if r.loss_start is not None:
                assert whole[:r.loss_start].endswith("<|im_start|>assistant\n") and whole[r.loss_start:r.loss_end].endswith("<|im_end|>\n")
    bob = [r.rendered for r in sorted(got, key=lambda r: r.seq) if (r.conv_id, r.perspective) == (1, "bob")]
    assert bob[:3] == ["<|im_start|>system\nbe kind<|im_end|>\n", "<|im_start|>user name=ann\nhi<|im_end|>\n",
                       "<|im_start|>assistant\nnaïve 😀<|im_end|>\n"]
    assert rotate(turns.where("false")).collect() == []


def exact(x, ids, query, k):
    score = (x * x[query]).sum(1)
    score[ids == ids[query]] = -np.inf
    best = np.lexsort((ids, -score))[:k]
    return [int(i) for i, s in zip(ids[best], score[best]) if s > -np.inf]


def test_ann_small_and_awkward(spark, scratch):
    from shortlist.llm.ann import nearest
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(0, 70)]
    good += [(i, good[0][1]) for i in range(100, 160)]                                  # one hot vector
    bad = [(200, None), (201, [0.0] * 8), (202, [None] + [1.0] * 7), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [1.0]),
           (None, [1.0] * 8), (220, [])]
    rows = [(i, v, 0, 0.0) for i, v in good + bad]
    got = nearest(stored(spark, scratch, rows, "vec_id bigint, embedding array<float>, list int, score double", "v")).collect()
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(np.float64)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append(r.vec_id)
    assert mine == {int(ids[q]): exact(x, ids, q, 20) for q in np.flatnonzero(ids % 20 == 0)}
    few = nearest(stored(spark, scratch, [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0])], "vec_id bigint, embedding array<float>", "few"))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few.collect()) == [(0, 1, 20, 4.0), (0, 2, 20, 4.0), (20, 1, 0, 4.0)]
    assert nearest(stored(spark, scratch, [], "vec_id bigint, embedding array<float>", "none", 1)).collect() == []


def test_ann_recall(spark, scratch):
    """Few probed lists still find nine tenths; blocks of lists meet blocks of queries."""
    from shortlist.llm import ann
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (4000, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(stored(spark, scratch, rows, "vec_id bigint, embedding array<float>", "r"), list_size=100, sample=1000).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    ids, x = np.arange(4000), x.astype(np.float64)
    want = {q: set(exact(x, ids, q, 20)) for q in range(0, 4000, 20)}
    assert set(mine) == set(want) and all(len(v) == 20 for v in mine.values())
    assert np.mean([len(mine[q] & want[q]) / 20 for q in want]) >= 0.9


def test_ann_whole_rows(spark, scratch):
    """With the whole table as the sample and few probed lists every query still has all its rows."""
    from shortlist.llm import ann
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = [(10_000 + 20 * i, (np.eye(32)[i] * 40).tolist()) for i in range(3)]                # lists of their own
    data = stored(spark, scratch, [(i, v.tolist()) for i, v in enumerate(x)] + far, "vec_id bigint, embedding array<double>", "u")
    for probes in (None, 1):
        got = ann.nearest(data, list_size=150, probes=probes).groupBy("query_id").count().collect()
        assert len(got) == 153 and {r["count"] for r in got} == {20}


def test_ann_repeated_rows(spark, scratch):
    """Own rows, however many, don't take the place of other ids; repeated rows are candidates each."""
    from shortlist.llm.ann import nearest
    rng = np.random.default_rng(9)
    one = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows = one + one + [one[20]] * 30                                          # doubled; id 20 32 times
    rows += [(40, (np.array(one[40][1]) * (1 + j / 100)).tolist()) for j in range(1, 30)]      # id 40 with 30 vectors
    got = nearest(stored(spark, scratch, rows, "vec_id bigint, embedding array<double>", "m")).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append(r.vec_id)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert all(mine[q] == exact(x, ids, q, 20) for q in (0, 20)) and len(mine[40]) == 20 and 40 not in mine[40]


def test_toxicity(spark, scratch):
    from shortlist.llm.toxicity import character_model, held_out, score
    rng = random.Random(4)
    calm = ["river", "stone", "window", "garden", "letter", "morning", "silver", "winter"]
    rude = ["idiot", "moron", "pathetic"]
    rows = []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(rng.randint(3, 30))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words), 9))
    extra = [(1000, "river m0r0n stone"), (1001, "i d i o t window"), (1002, "such a pathetiiic garden"), (1003, "river stone"), (1004, None),
             (1005, ""), (1006, "0123456789 " * 3000 + "stone"), (1007, "a1" * 5000), (1003, "river stone"), (None, "moron")]
    docs = stored(spark, scratch, rows + [(i, t, 9) for i, t in extra], "doc_id bigint, text string, score int", "docs").select("doc_id", "text")
    labels = stored(spark, scratch, [(i, 1 - i % 2, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 0, None), (5, 0, 0), (5, 0, 0)],
                    "doc_id bigint, quality int, toxic int", "labels")
    model = character_model(docs)
    assert model.shape == (28, 28, 28) and np.allclose(np.exp(model).sum(2), 1)
    got = score(docs, labels).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            if r.doc_id < 400:
                assert r.predicted == int(r.doc_id % 4 == 0)
    by = {r.doc_id: r.predicted for r in got}
    assert [by[i] for i in (1000, 1001, 1002, None)] == [1, 1, 1, 1] and [by[i] for i in (1003, 1004, 1005, 1006)] == [0, 0, 0, 0]
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert score(docs, some).count() == docs.count()
    assert score(docs.where("false"), labels).collect() == []


def test_toxicity_spaced_and_doubled(spark, scratch):
    """Words set apart begin anywhere in a stretch; pieces, underscores and doubled letters hide no word."""
    from shortlist.llm.toxicity import score
    rng = random.Random(8)
    calm = ["river", "stone", "window", "garden", "letter", "morning", "a", "you", "i", "am", "the", "is", "such", "to"]
    rows = []
    for i in range(600):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 30))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
    hidden = ["a m o r o n", "y o u i d i o t", "river id iot stone", "such a mo ron", "i_d_i_o_t river", "iiddiioott stone", "the idioot",
              "you 1d i0t"]
    fair = ["i am a river", "you is to the a", "a letter to you", "the river_stone", "window"]
    docs = stored(spark, scratch, rows + [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000 + i, t) for i, t in enumerate(fair)],
                  "doc_id bigint, text string", "docs")
    labels = stored(spark, scratch, [(i, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, toxic int", "labels")
    got = {r.doc_id: r.predicted for r in score(docs, labels).collect()}
    assert [t for i, t in enumerate(hidden) if not got[1000 + i]] == [] and [t for i, t in enumerate(fair) if got[2000 + i]] == []


def test_gaps_as_in_the_whole_lattice():
    """The lattice of gaps alone gives what the whole lattice gives."""
    from shortlist.llm.toxicity import LETTERS, decode, unspaced
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.full(LETTERS, 0.3), (LETTERS, LETTERS)) + 1e-9)
    some = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 4), replace=False)) for _ in range(rng.integers(2, 9))) for _ in range(300)]
    assert unspaced(some, model) == decode(some, model) and any(" " not in w for w in unspaced(some, model))


def test_viterbi_restores():
    from shortlist.llm.toxicity import LETTERS, decode
    flat = np.log(np.full((LETTERS,) * 3, 1 / LETTERS))
    assert decode(["m0r0n", "$tupid", "tr@sh", "x" * 700, "ünïc0de", ""], flat)[:3] == ["moron", "stupid", "trash"]


def test_pipeline(spark):
    import corpus_pipeline
    from shortlist.llm.common import store, table
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, docs, SF), name)
        left = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        if name == "substring_dedup":
            before = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
            want = brute.substring([t for _, t in before], 35)
            got = {r.doc_id: r.text for r in after.collect()}
            assert [hashlib.sha256(got[i].encode()).hexdigest() for i, _ in before] == [w[2] for w in want]
        if name == "simhash_near_dedup":
            before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert set(left) == set(brute.components([i for i, _ in before], [brute.simhash(t) for _, t in before], 4))
        if name == "bpe":
            lib, text = library(), {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert all(r.ids == lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids for r in after.collect())
        else:
            assert after.columns == columns
        docs, ids = after, set(left)
    assert ids and len(ids) < table(spark, SF, "documents").count()


def test_long_texts_without_spaces(monkeypatch):
    """Fronts composed by the prefix scan: entry states that soon meet, that cycle, and more of them than are guessed."""
    from sentencepiece import SentencePieceProcessor

    from shortlist.llm import tokencount
    lib, rng = SentencePieceProcessor(model_file=PIECES), random.Random(4)
    texts = ["ab" * 20000, "a" * 50000, "abcabd" * 7000, "".join(rng.choice("ABCdefghijk0123+/") for _ in range(100000)),
             "".join(chr(rng.randrange(0x4e00, 0x5000)) for _ in range(30000)), "x" * 300 + " " + "y" * 9000, "short", ""]
    want = [len(lib.encode(t)) for t in texts]
    for guesses, warm in ((32, 48), (1, 0), (2, 3)):
        monkeypatch.setattr(tokencount, "GUESSES", guesses)
        monkeypatch.setattr(tokencount, "WARM", warm)
        assert tokencount.Transducer(PIECES).count(texts).tolist() == want


def test_columns_named_like_results(spark, scratch):
    """An extra column with the name of a result gives way; in the pipeline it keeps its values."""
    import corpus_pipeline
    from shortlist.llm.bpe import encode
    from shortlist.llm.common import store, table, with_row_id
    from shortlist.llm.tokencount import count_tokens
    rows = [(i, t, -i, 0.5 - i, -1, "old", 9) for i, t in enumerate(["one two", "three", "river stone window"])]
    docs = stored(spark, scratch, rows, "doc_id bigint, text string, rid bigint, score double, predicted int, ids string, n_tokens int")
    assert sorted(r.n_tokens for r in count_tokens(docs, PIECES).collect()) != [9, 9, 9]
    assert all(isinstance(r.ids, list) for r in encode(docs, WORD_BPE).collect())
    with pytest.raises(ValueError, match="rid"):
        with_row_id(docs)
    wide = table(spark, SF, "documents").withColumns({"rid": -F.col("doc_id"), "score": F.col("doc_id") * 2.0, "predicted": F.lit(7), "row": F.lit("r")})
    wide = store(wide, "wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store(stage(spark, wide, SF), name)
        assert after.columns == wide.columns
        assert after.where("rid <> -doc_id OR score <> doc_id * 2 OR predicted <> 7 OR row <> 'r'").count() == 0 < after.count()
        wide = after


def test_doubled_letters_are_read_as_by_the_whole_lattice():
    from shortlist.llm.toxicity import LETTERS, decode, once
    rng = random.Random(2)
    model = np.log(np.random.default_rng(0).dirichlet(np.full(LETTERS, 0.3), (LETTERS, LETTERS)) + 1e-9)
    words = ["".join(rng.choice("abcde") * rng.choice([1, 1, 1, 2, 2, 3]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    words += ["", "a", "aa", "äää", "mmoorroonn", "b0ok", "x" * 300]
    assert once(words, model) == decode(words, model)


def test_readings_are_the_best_of_all_lattice_paths():
    """Every path through the lattice of a short word, spelled out."""
    from itertools import product

    from shortlist.llm.toxicity import AS_SIGN, LEET, LETTERS, PADDING, REPEATED, decode
    model = np.log(np.random.default_rng(5).dirichlet(np.full(LETTERS, 0.4), (LETTERS, LETTERS)) + 1e-9)
    rng = random.Random(9)
    for _ in range(150):
        word = "".join(rng.choice("abio013$!aab") for _ in range(rng.randrange(1, 7)))
        options = []
        for t, c in enumerate(word):
            same = t and word[t - 1] == c
            if c in LEET:
                options.append([(x, AS_SIGN) for x in LEET[c]] + [("", REPEATED + AS_SIGN if same else PADDING)])
            else:
                options.append([(c, 0.0)] + ([("", REPEATED)] if same else []))
        best: dict[str, float] = {}
        for path in product(*options):
            text = "".join(x for x, _ in path)
            codes = [0, 0, *(ord(x) - 96 for x in text), 0]
            value = sum(v for _, v in path) + sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            best[text] = max(best.get(text, -np.inf), value)
        assert best[decode([word], model)[0]] == pytest.approx(max(best.values()), abs=1e-9)


def test_known_features_are_those_of_the_words():
    from shortlist.llm.toxicity import _known_features, features
    known = {f: i for i, f in enumerate(["idio*", "moron", "a", "ab*", "abcd*", "abcde*", "abcdef*", "e*", "*", "bäre*"])}
    words = ["moron", "idiot", "idio", "idi", "abcdefgh", "*", "e*", "", "a", "bären", "idio*"]
    size, flat = _known_features(words, known)
    ends = np.cumsum(size)
    assert [sorted(flat[e - n:e].tolist()) for n, e in zip(size.tolist(), ends.tolist())] == [
        sorted(known[f] for f in features(w) if f in known) for w in words]


def test_workers_give_memory_back(spark, scratch):
    """What one slice took is free before the next: blocks of no arena, the last of them kept."""
    from shortlist.llm.common import map_slices
    docs = stored(spark, scratch, [(i, "x" * 2000) for i in range(4)], "doc_id bigint, text string", "slices", 1)
    held = []

    def run(batch):
        import re
        from pathlib import Path

        import pyarrow as pa
        before = int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
        some = [bytes(1000) for _ in range(150_000)]
        held.append(some[-1])
        yield pa.RecordBatch.from_pydict({"mb": pa.array([before], pa.int64())})
    mb = sorted(r.mb for r in map_slices(docs, run, "mb bigint", max_bytes=1000).collect())
    assert len(mb) == 4 and mb[-1] - mb[0] < 60


def test_row_ids_start_no_python(spark, scratch):
    from shortlist.llm.common import with_row_id
    docs = stored(spark, scratch, [(i, "x") for i in range(9)], "doc_id bigint, text string", "numbered")
    rows = with_row_id(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert rows.select("rid").distinct().count() == 9


def test_pipeline_toxicity_sends_a_text_once(spark, monkeypatch):
    import corpus_pipeline
    from shortlist.llm import toxicity
    from shortlist.llm.common import table
    seen = []
    monkeypatch.setattr(toxicity, "score", lambda docs, labels: seen.append(docs.schema) or docs.withColumn("predicted", F.lit(0)))
    docs = table(spark, SF, "documents")
    after = corpus_pipeline.toxicity(spark, docs, SF)
    assert "text" in seen[0].names and "text" not in seen[0]["row"].dataType.names
    assert after.columns == docs.columns and after.exceptAll(docs).count() == docs.exceptAll(after).count() == 0


def test_pipeline_batches_are_slices(spark):
    """Each stage asks for batches of a slice; a size that the session has already stays."""
    import corpus_pipeline
    from shortlist.llm.common import SLICE_BYTES, table
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", table(spark, SF, "documents")
    for held, want in ((None, str(SLICE_BYTES)), ("3000000", "3000000")):
        spark.conf.set(key, held) if held else spark.conf.unset(key)
        corpus_pipeline.bpe(spark, docs, SF)
        assert spark.conf.get(key) == want
    spark.conf.unset(key)
