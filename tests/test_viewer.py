"""Lists of a reader and an operator, and what names and bytes of files say, on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from paperlume.functions import files
from paperlume.operators import uploads, viewer


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "ext"), [("a/b/c.PDF", "pdf"), (".profile", ""), ("a.", ""), ("x.tar.gz", "gz"), ("dir.d/plain", ""), ("", ""), ("..a", "a")])
def test_extensions(spark, name, ext):
    assert one(spark, files.extension(F.lit(name))) == ext


@pytest.mark.parametrize(
    ("ext", "sniffed", "executable", "fits"),
    [("pdf", "PDF", False, True), ("PDF", "IMAGE", False, False), ("docx", "ARCHIVE", False, True), ("xls", "WORD", False, True), ("zip", "WORD", False, False), ("txt", "PDF", False, False), ("txt", None, False, True), ("csv", None, False, True), ("pdf", None, False, False), ("svg", None, False, True), ("png", None, False, False), ("exe", None, False, False), ("pdf", "PDF", True, False)],
)
def test_signatures(spark, ext, sniffed, executable, fits):
    assert one(spark, files.signature_fits(F.lit(ext), F.lit(sniffed).cast("string"), F.lit(executable))) is fits


@pytest.mark.parametrize(("path", "noise"), [("__MACOSX/a", True), ("a/__MACOSX/b", True), ("a__MACOSX/b", False), ("x/.DS_Store", True), ("Thumbs.db", True), ("a/._b", True), ("a._b", False), ("._a/b", False)])
def test_noise(spark, path, noise):
    assert one(spark, files.is_noise(F.lit(path))) is noise


def test_texts_of_files():
    assert files.decoded("&lt;a&gt; &amp;lt; &#65;&#x1F600; &apos;&quot; &nbsp; &#xD800;") == "<a> &lt; A" + chr(0x1F600) + " '\" &nbsp; &#xD800;"
    assert files.key_segment("Ünïcode  Rapport (final)--v2.PDF") == "u-ni-code-rapport-final-v2.pdf"
    assert files.key_segment("...--") == "" and len(files.key_segment("x" * 500)) == 120
    assert files.word_set("The Café's cafe, of 42 333!") == {"the", "cafe", "333"}


def test_columns_of_files(spark):
    rows = spark.createDataFrame([("a bbb ccc", "CCC"), ("", "x"), (None, None)], "a string, b string")
    assert [r["x"] for r in rows.select(files.text_consistency(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 1.0, 1.0]
    assert one(spark, files.object_key("originals", F.lit("w"), name=F.lit("***"))) == "originals/w/file"
    assert one(spark, files.append_capped(F.array(F.lit(1), F.lit(2)), F.array(*map(F.lit, (3, 4, 5, 6))))) == [1, 2, 3, 4, 5]
    assert one(spark, files.page_key(F.lit("w"), F.lit("v"), F.lit(7))) == "previews/w/v/pages/00007.webp"


def test_events_are_claimed_once(spark):
    arrived = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 0, 5), ("b", 3, 0), ("c", 1, 0), (None, 1, 0)], "event_id string, arrived_at int, delivery int")
    found = uploads.claim_events(arrived, spark.createDataFrame([("c",), ("c",)], "event_id string")).where("claimed").collect()
    assert {(r["event_id"], r["arrived_at"]) for r in found} == {("a", 0), ("b", 3), (None, 1)}


def test_targets_and_previews(spark):
    held = spark.createDataFrame([(1, 1, 9, False, "one"), (2, 1, None, False, "two"), (3, 1, 5, True, "gone"), (4, 2, 5, False, "other")], "file_id long, room long, pages long, removed boolean, name string")
    cited = spark.createDataFrame([(1, 1, 0), (1, 1, 99), (1, 1, None), (1, 2, 50), (1, 3, 1), (1, 4, 1), (2, 4, 0)], "room long, file_id long, page long")
    assert sorted((r["file_id"], r["page"]) for r in viewer.citation_target(cited, held).where("page IS NOT NULL").collect()) == [(1, 1), (1, 9), (2, 50), (4, 1)]
    art = [(1, 1, "page_image", 1, 10, 10), (1, 2, "page_image", 2, 3, 0), (1, 2, "page_image", 1, 30, 20), (2, 1, "sheet_html", 1, 0, 0), (4, 3, "text", 1, 0, 0), (3, 1, "page_image", 1, 1, 1)]
    shown = viewer.describe_previews(held, spark.createDataFrame(art, "file_id long, version long, kind string, page long, width long, height long")).collect()
    assert {r["file_id"]: (r["version"], r["kind"], r["page_count"], r["aspect_ratio"]) for r in shown} == {1: (2, "page_images", 2, 1.5), 2: (1, "sheets", 1, None), 4: (3, "document", None, None)}


def test_prompts(spark):
    turns = F.array(*(F.struct(F.lit("user" if k % 2 == 0 else "assistant").alias("role"), F.lit(f"t{k}" + "x" * 700).alias("text")) for k in range(8)))
    made = one(spark, viewer.user_prompt(F.transform(F.sequence(F.lit(1), F.lit(61)), lambda k: k.cast("string")), F.lit(None).cast("string"), 500, turns, F.lit("why?")))
    parts = made.split("\n\n")
    assert parts[0].startswith("SHARED MATERIAL (61 files)\n- 1\n") and parts[0].endswith("- 60\n- …") and parts[-1] == "QUESTION\nwhy?" and len(parts) == 4
    lines = parts[2].split("\n")
    assert len(lines) == 7 and lines[1].startswith("Reader: t2x") and lines[2].startswith("You: t3x") and len(lines[1]) == 608
    none = F.array().cast("array<struct<role: string, text: string>>")
    assert one(spark, viewer.user_prompt(F.array().cast("array<string>"), F.lit("Ann"), 9, none, F.lit("q"))) == "SHARED MATERIAL\n- document\n\nSHARED BY\nAnn\n\nQUOTE BUDGET\nVerbatim quotes in this answer must total no more than 9 characters.\n\nQUESTION\nq"
    assert one(spark, viewer.excerpt(F.lit("x" * 2101))) == "x" * 2100 + "…" and one(spark, viewer.excerpt(F.lit("x" * 2100))) == "x" * 2100
