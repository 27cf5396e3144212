"""Table I/O, JSON records and native HTML text extraction."""

import json
import os

import pytest
from pyspark.sql import functions as F

from paths import SF0001
from shortlist.schemas import RECORD_COLUMNS, RESUME_COLUMNS
from shortlist.sources import tables as tb
from shortlist.sources.extractors import default_extractor, html_to_text
from shortlist.plans import catalog as cat


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_resume_table_round_trip(spark, scratch, fmt):
    res = cat.resumes(spark, SF0001)
    path = os.path.join(scratch, f"resumes_{fmt}")
    tb.write_resumes(res, path, fmt=fmt)
    back = tb.read_resumes(spark, path, fmt=fmt)
    assert back.columns == RESUME_COLUMNS
    assert back.count() == res.count()
    assert back.where("Email IS NULL OR Phone IS NULL OR Skills_List IS NULL OR Exp_Years IS NULL").count() == 0
    assert sorted(back.select("Resume_ID", "Exp_Years").collect()) == \
        sorted(res.select("Resume_ID", "Exp_Years").collect())


def test_read_resumes_fills_missing(spark, scratch):
    path = os.path.join(scratch, "partial")
    spark.createDataFrame([("R0001", "a.pdf", "text")], "Resume_ID string, Source_File string, Resume_Text string") \
        .write.parquet(path)
    row = tb.read_resumes(spark, path).first()
    assert (row["Email"], row["Phone"], row["Skills_List"], row["Exp_Years"]) == ("", "", "", 0)


def test_records_json_and_sink(spark, scratch):
    top = cat.ranking(spark, SF0001).top_records()
    lines = [r[0] for r in tb.records_json(top).collect()]
    first = json.loads(lines[0])
    assert list(first) == RECORD_COLUMNS
    path = os.path.join(scratch, "records")
    tb.write_records(top, path)
    assert spark.read.json(path).count() == 5
    assert tb.preview(top, 2).count() == 2


def test_html_to_text(spark):
    html = ("<html><head><title>T&amp;C</title><style>p{x:1}</style>"
            "<script>var t=\"</p>\";</script></head><body><!-- ad --><p>Hello&nbsp;<b>world</b></p>"
            "<SCRIPT type='x'>evil()</SCRIPT>\n\n<p>a &lt; b &amp;lt;</p></body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(html_to_text("h")).first()[0]
    assert got == "T&C Hello world a < b &lt;"


def test_default_extractor():
    assert default_extractor("a.txt", "héllo".encode()) == "héllo"
    assert default_extractor("a.html", b"<p>x &amp; y</p>") == "x & y"
    # A .pdf member that is not a PDF is read as text; a PDF needs a decoder of the caller's.
    assert default_extractor("cv.pdf", b"plain words") == "plain words"
    with pytest.raises(ValueError):
        default_extractor("cv.pdf", b"%PDF-1.4 broken")


def test_character_references_of_the_column_form_equal_the_byte_form(spark):
    import html
    from html.entities import html5
    from shortlist.sources.extractors import _html_bytes_to_text, html_to_text, unescape
    traps = ["&amp;lt; &notit; &notin; &AMP &ampamp; &&amp; &; &x; &#; &#x; &#65;&#065&#x41;&#X0041 &#0; &#128; &#x9f; &#129; &#13;&#xd800; &#x110000;",
             "&#99999999999999999999; &#xFFFFFFFFFFFFFF; &#1; &#x0b; &#xFDD0; &#x1FFFF; &#x1F600; &#128512 &#xe9;t&eacute;&eacutex &copy2024 &frac12;&frac123",
             "no reference & here &", "", "a&nbsp;b&#160;c &Tab;x&NewLine;y", "&NotEqualTilde; &acE; &fjlig; &thisnamehasmorethanthirtytwocharactersinit; &#x41g &#6a",
             "&lt;b&gt;<b>&#60;i&#62;</b>"] + [f"&{n} &{n}x &{n.rstrip(';')}" for n in html5] + [f"&#{c}; &#x{c:x}z" for c in (*range(300), *range(0xFDC8, 0xFDF8), 0xFFFE, 0x10FFFF)]
    df = spark.createDataFrame(list(enumerate(traps)), "i int, h string").repartition(4)
    got = {r["i"]: (r["u"], r["t"]) for r in df.select("i", unescape(F.col("h")).alias("u"), html_to_text("h").alias("t")).collect()}
    assert [t for i, t in enumerate(traps) if got[i][0] != html.unescape(t)] == []
    assert [t for i, t in enumerate(traps) if got[i][1] != _html_bytes_to_text(t.encode())] == []
