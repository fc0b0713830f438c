"""What a reader and an operator see: files and folders, previews, places of citations, prompts, health and newest rows.

Top lists are limits over an order, which Spark takes per task first; all else is joins by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as names
from ..plans.registry import query
from ..sources.tables import events, jobs, oracle, subscriptions, table

#: Characters of the open page, and of a turn, and how many turns and names a prompt holds. Fixed values.
EXCERPT, TURN_CHARS, TURNS, NAMES = 2100, 600, 6, 60
#: Seconds after which a worker counts as gone. Fixed value.
SILENT = 60


def shared_files(spark, sf_dir) -> DataFrame:
    """Parts as the files of rooms: file_id, room, name, folder, sort, pages, container, removed."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % len(_EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file_id"), F.col("p_size").cast("long").alias("room"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("name"),
        F.col("p_brand").alias("folder"), F.floor("p_retailprice").cast("long").alias("sort"), F.when(ext.isin("pdf", "docx"), F.col("p_size").cast("long")).alias("pages"), (ext == "zip").alias("container"), (F.col("p_type") == "PROMO").alias("removed"),
    )


_EXTENSIONS = ["pdf", "docx", "XLSX", "png", "zip", "txt", "weird"]
_FILES = f"""files AS (SELECT p_partkey AS file_id, CAST(p_size AS BIGINT) AS room, p_name || ' ' || p_partkey || '.' || e AS name, p_brand AS folder, CAST(floor(p_retailprice) AS BIGINT) AS sort, CASE WHEN e IN ('pdf', 'docx') THEN CAST(p_size AS BIGINT) END AS pages, e = 'zip' AS container, p_type = 'PROMO' AS removed
FROM (SELECT *, {_EXTENSIONS!r}[CAST(1 + p_partkey % {len(_EXTENSIONS)} AS INTEGER)] AS e FROM part))"""


@query("viewer_payload", f"""WITH {_FILES}, live AS (SELECT * FROM files WHERE NOT removed), folders AS (SELECT folder, count(*) AS held FROM live WHERE folder <> 'Brand#1' GROUP BY folder)
SELECT room, row_number() OVER (PARTITION BY room ORDER BY sort, name, file_id)::INTEGER AS place, file_id, name, pages, f.folder AS folder, held AS folder_files, count(*) OVER (PARTITION BY room) > 1 AS multi_file FROM live l LEFT JOIN folders f ON l.folder = f.folder""")
def viewer_payload(spark, sf_dir):
    """The live files of each room in their order, with their folder where it is one of those known."""
    live = shared_files(spark, sf_dir).where("NOT removed")
    folders = live.where("folder <> 'Brand#1'").groupBy("folder").agg(F.count(F.lit(1)).alias("folder_files"))
    room = Window.partitionBy("room")
    found = live.withColumnRenamed("folder", "of").join(folders, F.col("of") == F.col("folder"), "left")
    return found.select("room", F.row_number().over(room.orderBy("sort", "name", "file_id")).alias("place"), "file_id", "name", "pages", "folder", "folder_files", (F.count(F.lit(1)).over(room) > 1).alias("multi_file"))


def citation_target(citations: DataFrame, files: DataFrame) -> DataFrame:
    """``citations`` (room, file_id, page, ...) whose file is live in the room, the page kept within the file's; unknown pages stay as they are."""
    known = files.where("NOT removed").select("room", "file_id", "pages")
    inside = F.least(F.greatest("page", F.lit(1)), "pages")
    return citations.join(known, ["room", "file_id"]).withColumn("page", F.when(F.col("page").isNotNull() & F.col("pages").isNotNull(), inside).otherwise(F.col("page"))).drop("pages")


@query("citation_target", f"""WITH {_FILES} SELECT l_orderkey AS answer, l_linenumber AS place, f.file_id, f.room, CASE WHEN page IS NOT NULL AND pages IS NOT NULL THEN least(greatest(page, 1), pages) ELSE page END AS page
FROM (SELECT *, CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) - 2 END AS page FROM lineitem) JOIN files f ON f.file_id = l_partkey AND f.room = CASE WHEN l_linenumber < 6 THEN f.room ELSE l_linenumber END AND NOT removed""")
def citation_target_query(spark, sf_dir):
    """Where the citations of answers lead; those into another room's file lead nowhere."""
    files = shared_files(spark, sf_dir)
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("file_id"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("long") - 2).alias("page"))
    own = cited.join(files.select("file_id", F.col("room").alias("home")), "file_id").withColumn("room", F.when(F.col("place") < 6, F.col("home")).otherwise(F.col("place").cast("long"))).drop("home")
    return citation_target(own, files).select("answer", "place", "file_id", "room", "page")


def describe_previews(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """How each live file is shown: its page images, else its sheets, else the document itself; by its current version alone.

    ``artifacts`` has file_id, version, kind, page, width and height; a file's current version is its greatest.
    """
    last = artifacts.groupBy("file_id").agg(F.max("version").alias("version"))
    images = F.col("kind") == "page_image"
    shown = artifacts.join(last, ["file_id", "version"]).groupBy("file_id", "version").agg(F.count_if(images).alias("images"), F.bool_or(F.col("kind") == "sheet_html").alias("sheets"), F.min(F.when(images, F.struct("page", "width", "height"))).alias("first"))
    kind = F.when(F.col("images") > 0, "page_images").when(F.col("sheets"), "sheets").otherwise("document")
    ratio = F.when((F.col("first.width") > 0) & (F.col("first.height") > 0), F.round(F.col("first.width") / F.col("first.height"), 6))
    live = files.where("NOT removed").select("file_id", "name")
    return live.join(shown, "file_id").select("file_id", "name", "version", kind.alias("kind"), F.when(F.col("images") > 0, F.col("images")).when(F.col("sheets"), F.lit(1)).alias("page_count"), ratio.alias("aspect_ratio"))


_ARTIFACTS = "art AS (SELECT l_partkey AS file_id, year(l_shipdate) AS version, CASE l_returnflag WHEN 'N' THEN 'page_image' WHEN 'R' THEN 'sheet_html' ELSE 'text' END AS kind, l_linenumber AS page, CAST(l_quantity AS BIGINT) AS width, l_orderkey % 90 AS height FROM lineitem WHERE l_linenumber < 3)"


def preview_artifacts(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "page_image").when(F.col("l_returnflag") == "R", "sheet_html").otherwise("text")
    return table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_partkey").alias("file_id"), F.year("l_shipdate").alias("version"), kind.alias("kind"), F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("long").alias("width"), (F.col("l_orderkey") % 90).alias("height"))


@query("preview_describe", f"""WITH {_FILES}, {_ARTIFACTS}, cur AS (SELECT a.* FROM art a JOIN (SELECT file_id, max(version) AS version FROM art GROUP BY file_id) USING (file_id, version)),
shown AS (SELECT file_id, version, count(*) FILTER (kind = 'page_image') AS images, bool_or(kind = 'sheet_html') AS sheets, min({{'page': page, 'width': width, 'height': height}}) FILTER (kind = 'page_image') AS f FROM cur GROUP BY ALL)
SELECT file_id, name, version, CASE WHEN images > 0 THEN 'page_images' WHEN sheets THEN 'sheets' ELSE 'document' END AS kind, CASE WHEN images > 0 THEN images WHEN sheets THEN 1 END AS page_count, CASE WHEN f.width > 0 AND f.height > 0 THEN round(f.width / f.height, 6) END AS aspect_ratio FROM files JOIN shown USING (file_id) WHERE NOT removed""")
def preview_describe(spark, sf_dir):
    return describe_previews(shared_files(spark, sf_dir), preview_artifacts(spark, sf_dir))


@query("preview_resolve", f"""WITH {_FILES}, {_ARTIFACTS}, cur AS (SELECT a.* FROM art a JOIN (SELECT file_id, max(version) AS version FROM art GROUP BY file_id) USING (file_id, version))
SELECT file_id, page, version, name || ' p' || page AS filename, 'previews/' || room || '/' || version || '/pages/' || lpad(page::VARCHAR, 5, '0') || '.webp' AS storage_key, count(*) AS copies FROM files JOIN cur USING (file_id) WHERE NOT removed AND kind = 'page_image' GROUP BY ALL""")
def preview_resolve(spark, sf_dir):
    """The object to stream for each page image of the current versions."""
    art = preview_artifacts(spark, sf_dir)
    last = art.groupBy("file_id").agg(F.max("version").alias("version"))
    rows = art.where("kind = 'page_image'").join(last, ["file_id", "version"]).join(shared_files(spark, sf_dir).where("NOT removed").select("file_id", "name", "room"), "file_id")
    key = names.page_key(F.col("room").cast("string"), F.col("version").cast("string"), F.col("page"))
    return rows.groupBy("file_id", "page", "version", F.concat("name", F.lit(" p"), "page").alias("filename"), key.alias("storage_key")).agg(F.count(F.lit(1)).alias("copies"))


@query("bundle_names", f"WITH {_FILES} SELECT room, list(name ORDER BY sort, file_id) AS names, count(*) AS files FROM files WHERE NOT removed AND NOT container GROUP BY room")
def bundle_names(spark, sf_dir):
    """The names of the live files of each room in order, archives left out."""
    live = shared_files(spark, sf_dir).where("NOT removed AND NOT container")
    return live.groupBy("room").agg(F.array_sort(F.collect_list(F.struct("sort", "file_id", "name"))).alias("held")).select("room", F.col("held.name").alias("names"), F.size("held").cast("long").alias("files"))


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """The beginning of a text, with an ellipsis where it is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


@query("active_excerpt", f"SELECT source AS file, page, CASE WHEN length(text) > {EXCERPT} THEN substr(text, 1, {EXCERPT}) || '…' ELSE text END AS excerpt FROM (SELECT source, doc_id % 7 AS page, arg_min(coalesce(text, ''), doc_id) AS text FROM documents GROUP BY ALL)")
def active_excerpt(spark, sf_dir):
    """The first unit of every page of every file, cut to what an open page may add to a prompt."""
    units = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file"), (F.col("doc_id") % 7).alias("page")).agg(F.min_by(F.coalesce("text", F.lit("")), "doc_id").alias("text"))
    return units.select("file", "page", excerpt(F.col("text")).alias("excerpt"))


def user_prompt(names_of: Column, sender: Column, quote_chars: int, history: Column, question: Column) -> Column:
    """The sections of a prompt, an empty line between them: the shared files, who shared them, the quote budget, the last turns and the question.

    ``history`` is an array of (role, text) in order; sections without content are left out.
    """
    bullets = F.transform(F.slice(names_of, 1, NAMES), lambda n: F.concat(F.lit("- "), n))
    many = F.concat(F.lit("SHARED MATERIAL ("), F.size(names_of), F.lit(" files)\n"), F.array_join(bullets, "\n"), F.when(F.size(names_of) > NAMES, "\n- …").otherwise(""))
    material = F.when(F.size(names_of) > 1, many).otherwise(F.concat(F.lit("SHARED MATERIAL\n- "), F.coalesce(F.try_element_at(names_of, F.lit(1)), F.lit("document"))))
    shared = F.when(F.coalesce(sender, F.lit("")) != "", F.concat(F.lit("SHARED BY\n"), sender))
    budget = F.lit(f"QUOTE BUDGET\nVerbatim quotes in this answer must total no more than {quote_chars} characters.")
    last = F.slice(history, F.greatest(F.size(history) - TURNS + 1, F.lit(1)), TURNS)
    turns = F.transform(last, lambda t: F.concat(F.when(t["role"] == "user", "Reader").otherwise("You"), F.lit(": "), F.substring(t["text"], 1, TURN_CHARS)))
    earlier = F.when(F.size(history) > 0, F.concat(F.lit("EARLIER IN THIS CONVERSATION\n"), F.array_join(turns, "\n")))
    return F.concat_ws("\n\n", material, shared, budget, earlier, F.concat(F.lit("QUESTION\n"), question))


@query("prompt_assembly", f"""WITH {_FILES}, held AS (SELECT room, list(name ORDER BY sort, file_id) AS names FROM files WHERE NOT removed AND NOT container GROUP BY room),
turns AS (SELECT conv_id, turn, min({{'role': role, 'text': coalesce(text, '')}}) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
asked AS (SELECT a.conv_id, a.turn, a.t.text AS question, list(b.t ORDER BY b.turn) FILTER (b.turn IS NOT NULL) AS history FROM turns a LEFT JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - {TURNS} WHERE a.t.role = 'user' GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN len(names) > 1 THEN 'SHARED MATERIAL (' || len(names) || ' files)' || chr(10) || array_to_string(list_transform(names[:{NAMES}], lambda n: '- ' || n), chr(10)) || CASE WHEN len(names) > {NAMES} THEN chr(10) || '- …' ELSE '' END ELSE 'SHARED MATERIAL' || chr(10) || '- ' || coalesce(names[1], 'document') END
|| CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'SHARED BY' || chr(10) || 'sender ' || conv_id ELSE '' END || chr(10) || chr(10) || 'QUOTE BUDGET' || chr(10) || 'Verbatim quotes in this answer must total no more than 500 characters.'
|| CASE WHEN len(history) > 0 THEN chr(10) || chr(10) || 'EARLIER IN THIS CONVERSATION' || chr(10) || array_to_string(list_transform(history, lambda t: CASE WHEN t.role = 'user' THEN 'Reader' ELSE 'You' END || ': ' || substr(t.text, 1, {TURN_CHARS})), chr(10)) ELSE '' END
|| chr(10) || chr(10) || 'QUESTION' || chr(10) || question AS prompt FROM asked LEFT JOIN held ON room = conv_id % 60""")
def prompt_assembly(spark, sf_dir):
    """The prompt of every question of a reader: the files of its room and the turns before it, met by the numbers of those turns."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", F.col("turn").cast("int").alias("turn")).agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    asked = turns.where("t.role = 'user'").select("conv_id", "turn", F.col("t.text").alias("question"))
    before = asked.select("conv_id", F.col("turn").alias("of"), F.explode(F.sequence(F.lit(1), F.lit(TURNS))).alias("back")).withColumn("turn", F.col("of") - F.col("back"))
    history = before.join(turns, ["conv_id", "turn"]).groupBy("conv_id", F.col("of").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("held")).select("conv_id", "turn", F.col("held.t").alias("history"))
    rooms = bundle_names(spark, sf_dir).select("room", "names")
    rows = asked.join(history, ["conv_id", "turn"], "left").withColumn("room", F.col("conv_id") % 60).join(rooms, "room", "left")
    none = F.array().cast("array<struct<role: string, text: string>>")
    sender = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("sender "), F.col("conv_id").cast("string")))
    return rows.select("conv_id", "turn", user_prompt(F.coalesce("names", F.array().cast("array<string>")), sender, 500, F.coalesce("history", none), F.col("question")).alias("prompt"))


@query("system_health", oracle(f"""SELECT worker, last_beat, n AS jobs_done, last_beat > now_at - INTERVAL {SILENT} SECOND AS alive, failed AS job_failure_rate, hook AS last_webhook_at FROM (SELECT user_id AS worker, max(ts) AS last_beat, count(*) AS n FROM events GROUP BY user_id ORDER BY last_beat DESC, worker LIMIT 10),
(SELECT max(ts) AS now_at, max(ts) FILTER (event_type = 'purchase') AS hook FROM events), (SELECT coalesce(round(count(*) FILTER (status = 'FAILED') / nullif(count(*), 0), 6), 0) AS failed FROM job WHERE started_at >= (SELECT max(started_at) FROM job) - INTERVAL 1 DAY)"""))
def system_health(spark, sf_dir):
    """The ten workers heard last and whether they are alive, today's failure rate of jobs, and the last webhook; the clock is the newest event."""
    log = table(spark, sf_dir, "events")
    newest = log.groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("last_beat"), F.count(F.lit(1)).alias("jobs_done")).orderBy(F.desc("last_beat"), "worker").limit(10)
    clock = log.agg(F.max("ts").alias("now_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_webhook_at"))
    work = jobs(spark, sf_dir)
    today = work.crossJoin(F.broadcast(work.agg(F.max("started_at").alias("last")))).where(F.col("started_at") >= F.col("last") - F.expr("INTERVAL 1 DAY"))
    failed = today.agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("status") == "FAILED"), F.count(F.lit(1))), 6), F.lit(0.0)).alias("job_failure_rate"))
    rows = newest.crossJoin(F.broadcast(clock)).crossJoin(F.broadcast(failed))
    return rows.select("worker", "last_beat", "jobs_done", (F.col("last_beat") > F.col("now_at") - F.expr(f"INTERVAL {SILENT} SECONDS")).alias("alive"), "job_failure_rate", "last_webhook_at")


@query("admin_home", oracle("""SELECT * FROM (SELECT 'workspace' AS list, c_custkey AS id, c_name AS name, NULL::TIMESTAMP AS at FROM customer ORDER BY c_custkey DESC LIMIT 6)
UNION ALL SELECT * FROM (SELECT 'active', sub_id, c_name, created_at FROM sub JOIN customer ON c_custkey = tenant WHERE status = 'active' ORDER BY created_at DESC, sub_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'canceled', sub_id, c_name, created_at FROM sub JOIN customer ON c_custkey = tenant WHERE status = 'canceled' ORDER BY created_at DESC, sub_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'failed payment', sub_id, c_name, created_at FROM sub LEFT JOIN customer ON c_custkey = tenant WHERE cancels ORDER BY created_at DESC, sub_id LIMIT 5)"""))
def admin_home(spark, sf_dir):
    """Four newest lists: workspaces, subscriptions that run, those that ended, and payments that failed."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("name"))
    subs = subscriptions(spark, sf_dir)

    def newest(name: str, rows: DataFrame, how: str) -> DataFrame:
        # The limit comes before the names where every row has one; else names are joined to rows that count.
        top = rows.join(people, "tenant", how).orderBy(F.desc("created_at"), "sub_id").limit(5)
        return top.select(F.lit(name).alias("list"), F.col("sub_id").alias("id"), "name", F.col("created_at").alias("at"))

    first = people.orderBy(F.desc("tenant")).limit(6).select(F.lit("workspace").alias("list"), F.col("tenant").alias("id"), "name", F.lit(None).cast("timestamp_ntz").alias("at"))
    lists = [newest("active", subs.where("status = 'active'"), "inner"), newest("canceled", subs.where("status = 'canceled'"), "inner"), newest("failed payment", subs.where("cancels"), "left")]
    for rows in lists:
        first = first.unionByName(rows)
    return first


@query("quality_runs", oracle("""SELECT date_trunc('day', occurred_at)::TIMESTAMP AS started_at, kind, count(*) AS cases, count(*) FILTER (duration_ms > 200000) AS blocking, count(*) FILTER (duration_ms > 200000) = 0 AS passed, max(occurred_at) AS finished_at FROM ev GROUP BY ALL ORDER BY started_at DESC, kind LIMIT 10"""))
def quality_runs(spark, sf_dir):
    """The ten newest runs, a run being a day's events of a kind, of which slow ones block."""
    slow = F.count_if(F.col("duration_ms") > 200000)
    runs = events(spark, sf_dir).groupBy(F.date_trunc("day", "occurred_at").cast("timestamp_ntz").alias("started_at"), "kind").agg(F.count(F.lit(1)).alias("cases"), slow.alias("blocking"), (slow == 0).alias("passed"), F.max("occurred_at").alias("finished_at"))
    return runs.orderBy(F.desc("started_at"), "kind").limit(10)


@query("golden_cases", "SELECT item_id AS case_id, 'room' || item_id % 3 AS room, length(text) > 0 AS answerable, length(text) AS question_chars FROM benchmark WHERE item_id % 3 = 1 ORDER BY item_id")
def golden_cases(spark, sf_dir, room: str | None = "room1"):
    """The golden cases of a room, or of all, by their keys."""
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.concat(F.lit("room"), (F.col("item_id") % 3).cast("string")).alias("room"), (F.length("text") > 0).alias("answerable"), F.length("text").cast("long").alias("question_chars"))
    return (cases if room is None else cases.where(F.col("room") == room)).orderBy("case_id")
