"""Archive ingest: entry selection, ordinals, fault tolerance, both read paths, streaming."""

import io
import os
import zipfile

from pyspark.sql import functions as F

from shortlist.operators.extract import extract_resumes
from shortlist.sources import archives as ar
from shortlist.streaming.ingest import archive_stream, resume_stream, start_ingest

LONG = "Jane Roe jane.ROE@Mail.com +1 (415) 555-0199 | 6 years of experience with Python and SQL. " * 2


def make_zip(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for name, text in entries:
            zf.writestr(name, text)
    return buf.getvalue()


ENTRIES = [("a/one.pdf", LONG), ("__MACOSX/x.pdf", LONG), ("sub/__MACOSX/y.pdf", "too short"),
           ("two.PDF", LONG.replace("Python", "Rust")), ("n.txt", LONG), ("dir.pdf/", "")]


def test_entries_from_bytes(spark):
    archives = ar.archives_from_bytes(spark, [("bundle.zip", make_zip(ENTRIES)), ("bad.zip", b"not a zip")])
    entries = ar.archive_entries(archives).orderBy("archive", "idx").collect()
    good = [(e["idx"], e["name"]) for e in entries if e["archive"] == "bundle.zip"]
    assert good == [(1, "a/one.pdf"), (2, "sub/__MACOSX/y.pdf"), (3, "two.PDF")]
    bad = [e for e in entries if e["archive"] == "bad.zip"]
    assert len(bad) == 1 and bad[0]["error"]


def test_resume_table_from_archive_bytes(spark):
    archives = ar.archives_from_bytes(spark, [("bundle.zip", make_zip(ENTRIES))])
    docs = ar.entry_texts(ar.archive_entries(archives))
    resumes = extract_resumes(docs.where(F.col("error").isNull())).orderBy("Resume_ID").collect()
    # The short member keeps its number: identifiers have a gap.
    assert [r["Resume_ID"] for r in resumes] == ["R0001", "R0003"]
    assert [r["Source_File"] for r in resumes] == ["one.pdf", "two.PDF"]
    first = resumes[0]
    assert first["Email"] == "jane.roe@mail.com"
    assert first["Exp_Years"] == 6
    assert first["Skills_List"] == "python, sql"
    assert resumes[1]["Skills_List"] == "rust, sql"


def test_listing_path_reads_members_from_files(spark, scratch):
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    with open(os.path.join(folder, "b1.zip"), "wb") as f:
        f.write(make_zip(ENTRIES))
    with open(os.path.join(folder, "b2.zip"), "wb") as f:
        f.write(make_zip([(f"p{i}.pdf", LONG + str(i)) for i in range(30)]))
    archives = ar.read_archives(spark, folder)
    members = ar.list_members(archives)
    docs = ar.read_members(members, partitions=4)
    resumes = extract_resumes(docs.where(F.col("error").isNull()))
    rows = resumes.collect()
    assert len(rows) == 2 + 30
    b2 = sorted(r["Resume_ID"] for r in rows if r["archive"].endswith("b2.zip"))
    assert b2 == [f"R{i:04d}" for i in range(1, 31)]
    # Listing reads no archive bytes: the binaryFile content column is pruned.
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_archives_are_opened_about_once_per_chunk(spark, scratch):
    """3 archives of 40 members in chunks of 10."""
    folder = os.path.join(scratch, "chunks")
    os.makedirs(folder)
    for a in range(3):
        with open(os.path.join(folder, f"c{a}.zip"), "wb") as f:
            f.write(make_zip([(f"p{i}.pdf", LONG + str(i)) for i in range(40)]))
    members = ar.list_members(ar.read_archives(spark, folder))
    rows = members.repartition(1).sortWithinPartitions("archive", "idx")
    docs = ar.read_members(rows, partitions=5, chunk=10)
    got = docs.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 120 and not [r for r in got if r["error"]]
    # Each chunk of consecutive members lies in one task, so an archive is opened at most once per chunk.
    assert all(len({r["part"] for r in got if r["archive"] == a and (r["idx"] - 1) // 10 == c}) == 1
               for a in {r["archive"] for r in got} for c in range(4))
    assert len({(r["archive"], r["part"]) for r in got}) <= 3 * 4


def test_streaming_ingest_available_now(spark, scratch):
    src = os.path.join(scratch, "drop")
    out = os.path.join(scratch, "resumes")
    ck = os.path.join(scratch, "ck")
    os.makedirs(src)
    with open(os.path.join(src, "s1.zip"), "wb") as f:
        f.write(make_zip(ENTRIES))
    q = start_ingest(resume_stream(archive_stream(spark, src), partitions=2), out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    with open(os.path.join(src, "s2.zip"), "wb") as f:
        f.write(make_zip([("c.pdf", LONG)]))
    q = start_ingest(resume_stream(archive_stream(spark, src), partitions=2), out, ck)
    q.awaitTermination(120)
    # Exactly once: the first archive is not re-ingested.
    assert spark.read.parquet(out).count() == 3


def test_observation_counts_members(spark):
    from pyspark.sql import Observation
    obs = Observation("ingest")
    archives = ar.archives_from_bytes(spark, [("bundle.zip", make_zip(ENTRIES))])
    docs = ar.entry_texts(ar.archive_entries(archives))
    rows = extract_resumes(docs.where(F.col("error").isNull()), observation=obs).collect()
    assert len(rows) == 2
    assert obs.get == {"members": 3, "extracted": 2}


def test_streaming_ingest_with_ranking_refresh(spark, scratch):
    from shortlist.functions.scoring import Criteria
    from shortlist.streaming.ingest import start_ranked_ingest
    src, table, top, ck = (os.path.join(scratch, d) for d in ("drop", "table", "top", "ck"))
    os.makedirs(src)
    entries = [(f"p{i}.pdf", LONG.replace("6 years", f"{i} years")) for i in range(1, 8)]
    with open(os.path.join(src, "a.zip"), "wb") as f:
        f.write(make_zip(entries))

    def semantic_for(resumes):
        # A stand-in similarity derived from the data (more years → closer).
        return resumes.select("archive", "Resume_ID", (F.col("Exp_Years") / 10.0).alias("Semantic_Score"))

    crit = Criteria(top_n=3, min_exp=2, skills=("!python",))
    q = start_ranked_ingest(resume_stream(archive_stream(spark, src), partitions=2), table, top, ck,
                            crit, semantic_for)
    q.awaitTermination(180)
    best = spark.read.parquet(top).orderBy(F.desc("Final_Score")).collect()
    assert [r["Exp_Years"] for r in best] == [7, 6, 5]
    assert spark.read.parquet(table).count() == 7


def test_unreadable_archives_stay_in_the_error_output(spark, scratch):
    os.makedirs(os.path.join(scratch, "in"))
    with open(os.path.join(scratch, "in", "good.zip"), "wb") as f:
        f.write(make_zip(ENTRIES))
    with open(os.path.join(scratch, "in", "bad.zip"), "wb") as f:
        f.write(b"no archive")
    docs = ar.read_members(ar.list_members(ar.read_archives(spark, os.path.join(scratch, "in"))), partitions=2)
    bad = docs.where(F.col("error").isNotNull()).collect()
    assert [r["archive"].endswith("bad.zip") for r in bad] == [True] and bad[0]["raw_text"] == ""


def test_stream_errors_have_an_output_of_their_own(spark, scratch):
    from shortlist.streaming.ingest import error_stream
    src, out, ck = (os.path.join(scratch, d) for d in ("drop", "errors", "ck"))
    os.makedirs(src)
    for name, data in (("good.zip", make_zip([("c.pdf", LONG)])), ("bad.zip", b"no archive")):
        with open(os.path.join(src, name), "wb") as f:
            f.write(data)
    start_ingest(error_stream(archive_stream(spark, src), partitions=2), out, ck).awaitTermination(180)
    rows = spark.read.parquet(out).collect()
    assert [r["archive"].rsplit("/", 1)[-1] for r in rows] == ["bad.zip"] and rows[0]["error"]


def test_a_repeated_batch_replaces_its_own_rows(spark, scratch):
    from shortlist.functions.scoring import Criteria
    from shortlist.operators.extract import extract_resumes
    from shortlist.streaming.ingest import refresh_ranking
    table, top = (os.path.join(scratch, d) for d in ("table", "top"))
    archives = ar.archives_from_bytes(spark, [("a.zip", make_zip([(f"p{i}.pdf", LONG) for i in range(3)]))])
    docs = ar.entry_texts(ar.archive_entries(archives))
    batch = extract_resumes(docs.where(F.col("error").isNull()), keep=("archive",))
    handle = refresh_ranking(table, top, Criteria(top_n=2),
                             lambda r: r.select("archive", "Resume_ID", F.lit(0.5).alias("Semantic_Score")))
    for batch_id in (0, 1, 1):
        handle(batch, batch_id)
    assert spark.read.parquet(table).groupBy("ingest_batch").count().count() == 2
    assert spark.read.parquet(table).count() == 6


def test_directories_are_read_once_and_members_by_their_place(spark, scratch):
    """Members of every method and place; after the listing no ZIP directory is opened."""
    import random
    rng = random.Random(3)
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    want = {}
    for a, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)):
        with open(os.path.join(folder, f"a{a}.zip"), "wb") as f:
            f.write(b"junk before the archive" * a)
            with zipfile.ZipFile(f, "a" if a else "w", method) as zf:
                for i in range(30):
                    text = LONG * rng.randrange(1, 40) + str(i)
                    zf.writestr(f"dir{i % 3}/é{i}.pdf", text)
                    want[f"a{a}.zip", i + 1] = (f"dir{i % 3}/é{i}.pdf", text)
    members = ar.list_members(ar.read_archives(spark, folder))
    rows = spark.createDataFrame(members.collect(), ar.MEMBER_LIST_SCHEMA)
    seen = spark.sparkContext.accumulator(0)

    def counting(name, data):
        import zipfile as z
        if not hasattr(z.ZipFile, "_counted"):
            opened = z.ZipFile.__init__
            def count(self, *args, **kwargs):
                seen.add(1)
                opened(self, *args, **kwargs)
            z.ZipFile.__init__, z.ZipFile._counted = count, True
        return data.decode()
    got = ar.read_members(rows, extractor=counting, partitions=4, chunk=7).collect()
    assert {(r["archive"].rsplit("/", 1)[-1], r["idx"]): (r["name"], r["raw_text"]) for r in got} == want
    assert seen.value == 0 and not [r for r in got if r["error"]]


def test_damaged_members_are_errors_of_their_own(spark, scratch):
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    data = bytearray(make_zip([("a.pdf", LONG), ("b.pdf", LONG + "b"), ("c.pdf", LONG + "c")]))
    second = data.index(LONG.encode() + b"b")
    data[data.index(b"PK\x03\x04", second)] ^= 1             # no header at the third member's place
    data[second + 5] ^= 1                                     # a wrong byte in the second one
    with open(os.path.join(folder, "a.zip"), "wb") as f:
        f.write(data)
    got = ar.read_members(ar.list_members(ar.read_archives(spark, folder)), partitions=2).orderBy("idx").collect()
    assert [(r["idx"], bool(r["error"])) for r in got] == [(1, False), (2, True), (3, True)] and got[0]["raw_text"] == LONG
    assert "CRC" in got[1]["error"] and "header" in got[2]["error"]


def test_chunks_are_cut_by_bytes(spark, scratch, monkeypatch):
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.zip"), "wb") as f:
        f.write(make_zip([(f"p{i}.pdf", LONG * 10) for i in range(40)]))
    monkeypatch.setattr(ar, "CHUNK_BYTES", 4 * len(LONG * 10))
    docs = ar.read_members(ar.list_members(ar.read_archives(spark, folder)), partitions=8)
    got = docs.withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r["part"] for r in got}) > 3


def test_resumes_and_errors_from_one_pass(spark, scratch):
    from shortlist.streaming.ingest import start_ingest_with_errors
    src, out, bad, ck, log = (os.path.join(scratch, d) for d in ("drop", "resumes", "errors", "ck", "log"))
    os.makedirs(src)
    os.makedirs(log)
    for name, data in (("good.zip", make_zip([("c.pdf", LONG), ("d.pdf", LONG + "d")])), ("bad.zip", b"no archive")):
        with open(os.path.join(src, name), "wb") as f:
            f.write(data)

    def logged(name, data):
        import tempfile
        tempfile.mkstemp(prefix=name, dir=log)
        return data.decode()
    start_ingest_with_errors(archive_stream(spark, src), out, bad, ck, extractor=logged, partitions=2).awaitTermination(180)
    assert sorted(r["Source_File"] for r in spark.read.parquet(out).collect()) == ["c.pdf", "d.pdf"]
    assert [r["archive"].rsplit("/", 1)[-1] for r in spark.read.parquet(bad).collect()] == ["bad.zip"]
    assert len(os.listdir(log)) == 2      # each member was decoded once for both outputs


def test_merged_ranking_state_equals_ranking_everything(spark, scratch):
    """A batch reads itself and the state; thresholds, labels and top are those of the whole table."""
    from shortlist.functions.scoring import Criteria
    from shortlist.operators.extract import extract_resumes
    from shortlist.operators.rank import rank
    from shortlist.streaming.ingest import refresh_ranking
    table, top = (os.path.join(scratch, d) for d in ("table", "top"))
    crit = Criteria(top_n=4, min_exp=2, skills=("!python",))
    asked = []

    def semantic_for(r):
        asked.append(r.count())
        return r.select("archive", "Resume_ID", (F.col("Exp_Years") / 40.0).alias("Semantic_Score"))
    handle = refresh_ranking(table, top, crit, semantic_for)
    for batch_id, sizes in enumerate(((1, 9), (20, 5), (7, 3))):
        made = [(f"p{i}.pdf", LONG.replace("6 years", f"{(i * 7 + batch_id) % 31} years")) for i in range(*sorted(sizes))]
        archives = ar.archives_from_bytes(spark, [(f"a{batch_id}.zip", make_zip(made))])
        docs = ar.entry_texts(ar.archive_entries(archives))
        batch = extract_resumes(docs.where(F.col("error").isNull()), keep=("archive",))
        for _ in range(1 + batch_id % 2):      # a repeated batch changes nothing
            handle(batch, batch_id)
        whole = spark.read.parquet(table).drop("ingest_batch")
        want = rank(whole, whole.select("archive", "Resume_ID", (F.col("Exp_Years") / 40.0).alias("Semantic_Score")), crit,
                    on=["archive", "Resume_ID"]).top_records().collect()
        assert sorted(map(tuple, spark.read.parquet(top).drop("batch_id").collect())) == sorted(map(tuple, want))
    assert asked == [8, 15, 15, 4]


def test_indexed_ingest_ranks_by_the_job_description(spark, scratch):
    from shortlist.functions.scoring import Criteria
    from shortlist.operators.rank import rank_documents
    from shortlist.streaming.ingest import start_indexed_ingest
    src, index, top, ck = (os.path.join(scratch, d) for d in ("drop", "index", "top", "ck"))
    os.makedirs(src)
    crit = Criteria("Rust and Python work", top_n=3, min_exp=0, skills=("sql",))
    texts = [LONG, LONG.replace("Python", "Rust"), LONG + "Rust Rust", LONG.replace("SQL", "Go"), LONG + "work"]
    for k in range(2):
        with open(os.path.join(src, f"s{k}.zip"), "wb") as f:
            f.write(make_zip([(f"{k}{i}.pdf", t + str(i + k)) for i, t in enumerate(texts[k:])]))
        resumes = resume_stream(archive_stream(spark, src), partitions=2)
        start_indexed_ingest(resumes, index, top, ck, crit).awaitTermination(180)
    docs = ar.read_members(ar.list_members(ar.read_archives(spark, src)), partitions=2)
    want = rank_documents(extract_resumes(docs, keep=("archive",)), crit).top_records().collect()
    assert sorted(map(tuple, spark.read.parquet(top).drop("batch_id").collect())) == sorted(map(tuple, want))


def test_an_archive_without_valid_resumes_fails_when_read(spark, scratch):
    import pytest
    from shortlist.operators.extract import resumes_of_archives
    from shortlist.operators.guards import nonempty
    for name, entries in (("good", ENTRIES), ("bad", [("a.pdf", "too short"), ("n.txt", LONG)])):
        os.makedirs(os.path.join(scratch, name))
        with open(os.path.join(scratch, name, "a.zip"), "wb") as f:
            f.write(make_zip(entries))
    good = resumes_of_archives(ar.read_archives(spark, os.path.join(scratch, "good")), partitions=2)
    assert sorted(r["Source_File"] for r in good.collect()) == ["one.pdf", "two.PDF"]
    bad = resumes_of_archives(ar.read_archives(spark, os.path.join(scratch, "bad")), partitions=2)
    with pytest.raises(Exception, match="No valid resumes"):
        bad.collect()
    with pytest.raises(Exception, match="is empty"):
        nonempty(spark.range(0)).count()
    assert nonempty(spark.range(3)).count() == 3
