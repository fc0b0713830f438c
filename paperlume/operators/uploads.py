"""Files as they come in: entries that are noise, kinds by name and by content, keys, texts of previews, claims of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as names
from ..functions.html import html_to_text
from ..functions.text import strip_tags
from ..plans.registry import query
from ..sources.tables import table
from .access import document_kind, looks_executable

#: Where entries of archives lie, in turn, and extensions of names with the first bytes of their contents.
_PLACES = ["docs/{}.pdf", "__MACOSX/{}", "a/__MACOSX/{}", "a/.DS_Store/{}", "x/Thumbs.db", "._{}", "b/._{}", "my__MACOSX/{}"]
_ENDS = [".pdf", ".DOCX", ".xls", ".png", ".zip", ".txt", ".svg", ".csv", "", ".", ".weird", ".odg"]
_HEADS = ["255044462D", "504B030414", "D0CF11E0A1", "89504E470D", "4D5A900003", "68656C6C6F", ""]


def _turn(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


@query("noise_path", f"""SELECT doc_id, path, starts_with(path, '__MACOSX/') OR contains(path, '/__MACOSX/') OR list_has_any(string_split(path, '/'), ['.DS_Store', 'Thumbs.db']) OR starts_with(string_split(path, '/')[-1], '._') AS noise
FROM (SELECT doc_id, replace({_PLACES!r}[CAST(1 + doc_id % {len(_PLACES)} AS INTEGER)], '{{}}', source) AS path FROM documents)""")
def noise_path(spark, sf_dir):
    path = F.replace(_turn(_PLACES, F.col("doc_id")), F.lit("{}"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("noise", names.is_noise(F.col("path")))


_KIND_SQL = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr(x) for x in held.split())}) THEN '{kind}'" for kind, held in names.KINDS.items()) + " ELSE 'UNKNOWN' END"
_NAMED = f"""named AS (SELECT p_partkey AS id, p_name || {_ENDS!r}[CAST(1 + p_partkey % {len(_ENDS)} AS INTEGER)] AS name, {_HEADS!r}[CAST(1 + p_partkey // {len(_ENDS)} % {len(_HEADS)} AS INTEGER)] AS h FROM part),
typed AS (SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS e FROM named))"""


def _uploads(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat("p_name", _turn(_ENDS, F.col("p_partkey"))).alias("name"), F.unhex(_turn(_HEADS, F.expr(f"p_partkey DIV {len(_ENDS)}"))).alias("head"))


@query("describe_file", f"WITH {_NAMED} SELECT id, name, e AS extension, kind FROM typed")
def describe_file(spark, sf_dir):
    """The extension of each name and the kind of document it stands for."""
    rows = _uploads(spark, sf_dir).select("id", "name", names.extension(F.col("name")).alias("extension"))
    return rows.withColumn("kind", names.kind_of(F.col("extension")))


@query("sig_match", f"""WITH {_NAMED}, sniffed AS (SELECT *, CASE WHEN h LIKE '25504446%' THEN 'PDF' WHEN h LIKE '504B0304%' THEN 'ARCHIVE' WHEN h LIKE 'D0CF11E0%' THEN 'WORD' WHEN h LIKE '89504E47%' THEN 'IMAGE' END AS s FROM typed)
SELECT id, e AS extension, s AS sniffed, CASE WHEN kind = 'UNKNOWN' OR h LIKE '4D5A%' THEN false WHEN s IS NULL THEN e = 'svg' OR kind IN ('TEXT', 'SPREADSHEET', 'WORD') WHEN kind = 'TEXT' THEN false
WHEN s = 'ARCHIVE' THEN kind IN ('ARCHIVE', 'WORD', 'SLIDES', 'SPREADSHEET') WHEN s = 'WORD' THEN kind IN ('WORD', 'SLIDES', 'SPREADSHEET') ELSE s = kind END AS fits FROM sniffed""")
def sig_match(spark, sf_dir):
    """Whether the first bytes of each file are those that its name promises."""
    rows = _uploads(spark, sf_dir).select("id", names.extension(F.col("name")).alias("extension"), document_kind(F.col("head")).alias("sniffed"), looks_executable(F.col("head")).alias("executable"))
    return rows.select("id", "extension", "sniffed", names.signature_fits(F.col("extension"), F.col("sniffed"), F.col("executable")).alias("fits"))


@query("xml_entities")
def xml_entities(spark, sf_dir):
    """Pages with their entities as characters."""
    return table(spark, sf_dir, "pages").select("page_id", names.xml_text(F.col("html")).alias("text"))


@query("text_consistency")
def text_consistency(spark, sf_dir):
    """How many of the words of each page its text without scripts still shows."""
    rows = table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("source"), html_to_text(F.col("html"), drop_scripts=True).alias("shown"))
    return rows.select("page_id", F.round(names.text_consistency(F.col("source"), F.col("shown")), 6).alias("consistency"))


@query("storage_keys")
def storage_keys(spark, sf_dir):
    """Where the original of each document is stored, its first words for a name."""
    rows = table(spark, sf_dir, "documents")
    key = names.object_key("originals", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), name=F.concat(F.substring("text", 1, 60), F.lit(".PDF")))
    return rows.select("doc_id", key.alias("key"))


def claim_events(arrived: DataFrame, known: DataFrame, key: str = "event_id") -> DataFrame:
    """Of events as they arrived (with ``arrived_at``) each with whether it is new: the first of its key, and not among those known."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("arrived_at", "delivery")) == 1
    seen = known.select(key).distinct().withColumn("seen", F.lit(True))
    return arrived.withColumn("first", first).join(seen, key, "left").withColumn("claimed", F.col("first") & F.col("seen").isNull()).drop("first", "seen")


@query("stripe_claim", """WITH arrived AS (SELECT o_orderkey AS event_id, o_orderdate AS arrived_at, 0 AS delivery FROM orders UNION ALL SELECT o_orderkey, o_orderdate, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT event_id, arrived_at, delivery, row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, delivery) = 1 AND o.l_orderkey IS NULL AS claimed FROM arrived LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45) o ON o.l_orderkey = event_id""")
def stripe_claim(spark, sf_dir):
    """Orders as webhooks, delivered again for each line that came back; an event is taken once, and not if it was before."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("arrived_at"))
    again = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("delivery")).join(orders, "event_id")
    arrived = orders.withColumn("delivery", F.lit(0)).unionByName(again)
    return claim_events(arrived, lines.where("l_linestatus = 'F' AND l_quantity > 45").select(F.col("l_orderkey").alias("event_id"))).select("event_id", "arrived_at", "delivery", "claimed")


@query("append_capped", "SELECT conv_id, list_concat(held, new)[:5] AS examples FROM (SELECT conv_id, coalesce(list(left(text, 200) ORDER BY turn) FILTER (role = 'user' AND turn < 4), []) AS held, coalesce(list(left(text, 200) ORDER BY turn) FILTER (role = 'user' AND turn >= 4), []) AS new FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL) GROUP BY conv_id)")
def append_capped(spark, sf_dir):
    """The first five questions of each conversation, the later ones appended to the earlier."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    of = lambda late: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "user") & ((F.col("turn") >= 4) == late), F.struct("turn", F.substring("text", 1, 200).alias("t"))))), lambda x: x["t"])
    first = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where((F.col("n") <= 5) | (F.col("role") != "user"))
    return first.groupBy("conv_id").agg(of(False).alias("held"), of(True).alias("new")).select("conv_id", names.append_capped(F.col("held"), F.col("new")).alias("examples"))
