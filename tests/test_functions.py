"""Example cases of functions and operators."""

import datetime

from pyspark.sql import functions as F

from paperlume.functions import classify, html, text
from paperlume.operators import access, documents, retrieval, texts
from paperlume.plans import registry
from paperlume.sources.tables import cost_usd
from paperlume.streaming import events as streams


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_cost_of_the_usual_question(spark):
    assert one(spark, cost_usd(F.lit("answer"), F.lit(6000), F.lit(0), F.lit(350))) == 0.00162
    assert one(spark, cost_usd(F.lit("answer"), F.lit(100), F.lit(500), F.lit(0))) == 0.000002
    assert one(spark, cost_usd(F.lit("other"), F.lit(100), F.lit(0), F.lit(0))) == 0.0


def test_requests_for_whole_texts(spark):
    verdict = lambda q, **k: one(spark, classify.classify_request(F.lit(q), **k))
    assert verdict("Give me the entire document word for word")["blocked"]
    assert verdict("What does the termination clause say?")["intent"] == "none"
    assert verdict("print pages 3 through 25", mode="STRICT")["blocked"]
    assert not verdict("print pages 3 through 25")["blocked"]
    assert verdict("print pages 3 through 25", attempts=F.lit(2))["score"] == 0.79


def test_topics_and_refusals(spark):
    assert one(spark, classify.topic(F.lit("What is the notice period and liability?")))["slug"] == "contract"
    assert one(spark, classify.topic(F.lit("xyz")))["slug"] == "general"
    assert one(spark, classify.is_refusal(F.lit("I couldn't find that.")))
    assert not one(spark, classify.is_refusal(F.lit("The fee is 50.")))


def test_text(spark):
    assert one(spark, text.normalise_whitespace(F.lit("a\r\n\r\n\r\n\r\nb   c\x01 "))) == "a\n\nb c"
    assert one(spark, text.estimate_tokens(F.lit("x" * 37))) == 11
    assert one(spark, text.lexical_terms(F.lit("What is the annual Fee?"))) == ["annual", "fee"]
    assert one(spark, text.is_complex(F.lit("compare both offers")))


def test_access(spark):
    assert one(spark, access.email_allowed(F.lit(" A@X.com "), F.array(F.lit("b@y.com")), F.array(F.lit("x.com"))))
    assert one(spark, access.safe_path(F.lit("../etc"))) is None
    assert one(spark, access.safe_path(F.lit("a\\b/./c"))) == "a/b/c"
    assert [one(spark, access.column_letter(F.lit(k))) for k in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, access.sniff_kind(F.lit(b"%PDF-1.7"))) == "pdf"
    assert one(spark, access.looks_executable(F.lit(b"MZ\x90")))


def test_fusion_prefers_agreement(spark):
    ranked = lambda ids: spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "question_id long, chunk_id long, rank int")
    rows = retrieval.fuse(ranked([1, 2, 3]), ranked([2, 4])).orderBy(F.desc("score"), "chunk_id").collect()
    assert rows[0]["chunk_id"] == 2 and rows[0]["agreement"] and len(rows) == 4


def test_budget_keeps_the_first_and_stops(spark):
    rows = spark.createDataFrame([(0, 1, 900), (0, 2, 50), (0, 3, 10)], "question_id long, pos int, tokens int")
    assert [r["pos"] for r in retrieval.fit_budget(rows, 100).collect()] == [1]
    assert [r["pos"] for r in retrieval.fit_budget(rows, 955).orderBy("pos").collect()] == [1, 2]


def test_diversify_backfills(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 1, 3), (0, 2, 4)], "question_id long, file_id long, pos int").withColumn("was", F.col("pos"))
    assert [r["was"] for r in retrieval.diversify(rows, 4, 2).orderBy("pos").collect()] == [1, 2, 4, 3]


def test_chunks(spark):
    long = ". ".join(f"Sentence number {k} says a little about it" for k in range(400)) + "."
    docs = spark.createDataFrame([(1, "# Head\nBody text here."), (2, None), (3, long), (4, "x" * 5000)], "doc_id long, text string")
    rows = documents.chunk_documents(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 3, 4}
    assert all(r["tokens"] <= documents.SIZES[""].most + 20 for r in rows)
    assert [s["title"] for s in documents.split_sections(docs.where("doc_id = 1")).collect()] == ["Head"]


def test_stream_deduplication_rollup_and_counters(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", at, 1), ("a", at, 2), ("b", at + datetime.timedelta(seconds=5), 3)]
    spark.createDataFrame(rows, "idempotency_key string, occurred_at timestamp, n int").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        stream = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.table(name).collect()

    source = spark.readStream.schema("idempotency_key string, occurred_at timestamp, n int").parquet(str(tmp_path / "in"))
    assert len(run(streams.deduplicated(source), "once")) == 2
    rollup = streams.windowed_rollup(source.selectExpr("occurred_at", "idempotency_key AS tenant", "CAST(n AS BIGINT) AS duration_ms"), width="5 seconds", delay="0 seconds")
    # The window of b is open still.
    assert [(r["tenant"], r["n"], r["dwell_ms"], r["window"]["start"]) for r in run(rollup, "rollup")] == [("a", 2, 3, at)]
    counted = run(streams.counters(source.withColumn("kind", F.lit("k")), ["idempotency_key"]), "counted", "complete")
    assert {tuple(r) for r in counted} == {("a", "k", 2), ("b", "k", 1)}


HTML = [
    ("<h2>T</h2><ul><li>x</li></ul>a &amp;lt; b", "## T\n\n- x\n\na &lt; b"),
    ("<H3 class='a'>One <b>two</b>\n  three<br></h3>rest", "### One two three\n\nrest"),
    ("<ul><li> a <i>b</i>\n<br/>c</li><LI>d</LI></ul>", "- a b c\n- d"),
    ("<li>open <p>x</p><h1>H</h1>", "open x\n\n# H"),
    ("<li>in <h4>Head</h4> out</li>z", "- in #### Head outz"),
    ("<li>a<li>b</li>c", "- abc"),
    ("<h1>never <h2>closed</h2>", "never\n\n## closed"),
    ("<table><tr><th>a</th> <td x='1'>b</td></tr><tr><td>c</td></tr></table>", "a | b\nc"),
    ("a<br>b<BR />c<div>d</div>e<p>f</P>\n\n\ng", "a\nb\ncd\n\nef\n\ng"),
    ("x  \t y   \n z&nbsp;&nbsp;w &quot;&#39;&gt;", "x y\n z w \"'>"),
    ("1 < 2 and 3", "1 < 2 and 3"),
    ("a <> b", "a <> b"),
    (chr(0x130) + "<li>" + chr(0x130) + "</li>", chr(0x130) + "\n- " + chr(0x130)),
    ("", ""),
    (None, None),
]


def test_html(spark):
    rows = spark.createDataFrame(list(enumerate(h for h, _ in HTML)), "id long, h string").select("id", html.html_to_text(F.col("h")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == dict(enumerate(t for _, t in HTML))
    assert html.structured_text("a<script>if (1 < 2) {}</script><style>p</style>b", drop_scripts=True) == "ab"
    # Items that are never closed are not sought again and again.
    assert html.structured_text("<li>x" * 20_000).count("x") == 20_000


def test_themes_and_their_first_questions(spark, tmp_path):
    turns = [(k // 2, k % 2, "user", f"What does the license cost for {k}?") for k in range(30)] + [(9, 9, "user", "uptime?"), (1, 1, "assistant", "fee")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["slug"]: (r["questions"], [(e["conv_id"], e["turn"]) for e in r["examples"]]) for r in registry.QUERIES["topic_rollup"](spark, str(tmp_path)).collect()}
    assert found == {"pricing": (30, [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]), "support": (1, [(9, 9)])}


def test_vectors_are_carried_by_content(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "chunk_id long, digest string")
    held = spark.createDataFrame([(9, "a", [9.0]), (5, "a", [5.0]), (6, "b", None), (7, None, [7.0])], "chunk_id long, digest string, embedding array<double>")
    assert {r["chunk_id"]: (r["reused_from"], r["embedding"]) for r in texts.reuse_vectors(chunks, held).collect()} == {1: (5, [5.0]), 3: (5, [5.0]), 2: (None, None), 4: (None, None)}
