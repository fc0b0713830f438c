"""Who may read, ask and download: access decisions, quota arithmetic and file kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table

#: First bytes of known kinds, in hex. Fixed values.
SIGNATURES = {
    "pdf": ["25504446"], "zip": ["504B0304", "504B0506", "504B0708"], "png": ["89504E47"], "jpeg": ["FFD8FF"], "gif": ["47494638"], "bmp": ["424D"],
    "ole": ["D0CF11E0"], "riff": ["52494646"], "tiff": ["49492A00", "4D4D002A"],
}
#: A kind that is told by the bytes after the first four, and the kind of document each stands for. Fixed values.
BOX = "66747970"
DOCUMENT_KINDS = {"pdf": "PDF", "zip": "ARCHIVE", "png": "IMAGE", "jpeg": "IMAGE", "gif": "IMAGE", "bmp": "IMAGE", "ole": "WORD", "riff": "IMAGE", "tiff": "IMAGE", "box": "IMAGE"}
#: First bytes of executables, in hex. Fixed values.
EXECUTABLES = ["4D5A", "7F454C46", "FEEDFACE", "FEEDFACF", "CFFAEDFE", "CAFEBABE"]


def availability(status: Column, as_of: Column, expires_at: Column, revoked_at: Column, paused_at: Column, suspended: Column) -> Column:
    """Why a shared bundle is closed, or 'ok'; earlier reasons win. Expiry is reached at its instant."""
    return (
        F.when(suspended, "suspended").when(status == "DELETED", "deleted").when((status == "REVOKED") | revoked_at.isNotNull(), "revoked").when(status == "ARCHIVED", "archived")
        .when((status == "PAUSED") | paused_at.isNotNull(), "paused").when((status == "EXPIRED") | (expires_at <= as_of), "expired").when(status != "ACTIVE", "not_ready").otherwise("ok")
    )


def email_allowed(email: Column, emails: Column, domains: Column) -> Column:
    """Whether an address, or the domain after its last @, is listed; case and outer blanks do not count."""
    clean = F.lower(F.trim(email))
    listed = lambda values, value: F.coalesce(F.exists(values, lambda v: F.lower(F.trim(v)) == value), F.lit(False))
    return listed(emails, clean) | (clean.contains("@") & listed(domains, F.substring_index(clean, "@", -1)))


def derived_status(status: Column, expires_at: Column, as_of: Column) -> Column:
    return F.when((status == "ACTIVE") & (expires_at <= as_of), "EXPIRED").when((status == "EXPIRED") & (expires_at > as_of), "ACTIVE").otherwise(status)


def expires_soon(expires_at: Column, as_of: Column) -> Column:
    """Open now and for at most three days more."""
    return F.coalesce((expires_at > as_of) & (expires_at <= as_of + F.expr("INTERVAL 3 DAYS")), F.lit(False))


def quota(plan: Column, purchased: Column, adjustments: Column, consumed: Column) -> Column:
    """(allowance, remaining, utilisation); an allowance of zero is used up."""
    allowance = F.greatest(plan + purchased + adjustments, F.lit(0))
    used = F.when(allowance == 0, 1.0).otherwise(F.least(F.try_divide(consumed, allowance), F.lit(1.0)))
    return F.struct(allowance.alias("allowance"), F.greatest(allowance - consumed, F.lit(0)).alias("remaining"), used.alias("utilisation"))


def sniff_kind(header: Column) -> Column:
    """Kind of a file by its first bytes, null if unknown."""
    shown = F.hex(header)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, starts in SIGNATURES.items():
        for start in starts:
            out = out.when(shown.startswith(start), F.lit(kind))
    return out.when(F.substring(shown, 9, 8) == BOX, F.lit("box"))


def document_kind(header: Column) -> Column:
    """What the container of a file is used for: PDF, ARCHIVE, IMAGE or WORD, null if unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in DOCUMENT_KINDS.items() for x in pair)), sniff_kind(header))


def looks_executable(header: Column) -> Column:
    shown = F.hex(header)
    out = F.lit(False)
    for start in EXECUTABLES:
        out = out | shown.startswith(start)
    return out


def safe_path(path: Column, deepest: int = 20) -> Column:
    """The path with forward slashes, or null if it is absolute, climbs, is too deep or holds a NUL."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(clean, "/")
    bad = path.contains("\0") | clean.rlike(r"^(/|[A-Za-z]:)") | F.array_contains(parts, "..") | (F.size(parts) > deepest) | (F.length(clean) == 0)
    return F.when(~bad, F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/"))


def column_letter(index: Column) -> Column:
    """1 is A, 27 is AA; up to three letters."""
    letter = lambda k: F.chr((k % 26 + 65).cast("int"))
    one, two = index - 1, F.floor((index - 27) / 26)
    return F.when(index <= 26, letter(one)).when(index <= 702, F.concat(letter(two), letter(index - 27 - two * 26))).otherwise(
        F.concat(letter(F.floor((index - 703) / 676)), letter(F.floor((index - 703) % 676 / 26)), letter((index - 703) % 26))
    )


@query("expire_sweep", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' THEN 'EXPIRED' WHEN o_orderstatus = 'O' THEN 'ACTIVE' WHEN o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1998-01-01' THEN 'ACTIVE' WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'PAUSED' END AS status FROM orders""")
def expire_sweep(spark, sf_dir):
    """A snapshot with the status that the clock gives."""
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("PAUSED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), derived_status(status, F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("status"))


@query("next_version", "SELECT o_custkey AS file_id, coalesce(max(o_orderkey), 0) + 1 AS version FROM orders GROUP BY 1")
def next_version(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("version"))


@query("admin_search", r"""SELECT * FROM (SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_name ILIKE '%00001%' ORDER BY c_custkey LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_name ILIKE '%00001%' ORDER BY s_suppkey LIMIT 8) UNION ALL SELECT * FROM (SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_name ILIKE '%00001%' ORDER BY p_partkey LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderkey = 1 LIMIT 8)""")
def admin_search(spark, sf_dir, term: str = "00001"):
    """Three tables searched by a part of a name, wild cards taken literally, and one by its key."""
    escaped = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    key = int(term) if term.isascii() and term.isdigit() and len(term) < 19 else None
    searches = [(name, key_col, label, F.col(label).ilike(escaped)) for name, key_col, label in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    out = table(spark, sf_dir, "orders").where(F.col("o_orderkey") == F.lit(key)).limit(8).select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"))
    for name, key_col, label, fits in searches:
        out = out.unionByName(table(spark, sf_dir, name).where(fits).orderBy(key_col).limit(8).select(F.lit(name).alias("kind"), F.col(key_col).cast("string").alias("id"), F.col(label).alias("name")))
    return out


@query("paginate", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir, page: int = 3, size: int = 25):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return rows.offset((page - 1) * size).limit(size)


def access_code(available: Column, mode: Column, password_verified: Column, email: Column, emails: Column, domains: Column) -> Column:
    """'ok', or why a reader is refused: first what closes the bundle, then what its mode asks for."""
    has_email = F.coalesce(F.length(email) > 0, F.lit(False))
    by_mode = (
        F.when(mode == "PUBLIC", "ok").when(mode == "PASSWORD", F.when(password_verified, "ok").otherwise("password_required"))
        .when(mode == "EMAIL_LIST", F.when(~has_email, "identity_required").when(email_allowed(email, emails, domains), "ok").otherwise("email_not_allowed"))
        .when(mode == "IDENTIFIED", F.when(has_email, "ok").otherwise("identity_required")).otherwise("forbidden")
    )
    return F.when(available != "ok", available).otherwise(by_mode)


def resolve_expiration(preset: Column, custom: Column, as_of: Column) -> Column:
    """The instant that a preset ends at; null where it never does."""
    return F.when(preset == "24h", as_of + F.expr("INTERVAL 24 HOURS")).when(preset == "7d", as_of + F.expr("INTERVAL 168 HOURS")).when(preset == "30d", as_of + F.expr("INTERVAL 720 HOURS")).when(preset == "custom", custom)


def billing_cycle(anchor: Column, as_of: Column) -> Column:
    """(start, end) of the month-long cycle around ``as_of`` that begins on the anchor's day, or on a shorter month's last."""
    day_in = lambda month: F.make_date(F.year(month), F.month(month), F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(month))))
    this = F.trunc(as_of, "month")
    start = F.when(day_in(this) > F.to_date(as_of), day_in(F.add_months(this, -1))).otherwise(day_in(this))
    return F.struct(start.alias("start"), day_in(F.add_months(F.trunc(start, "month"), 1)).alias("end"))


def adjustment_applies(created_at: Column, expires_at: Column, recurring: Column, cycle: Column, as_of: Column) -> Column:
    """Whether an adjustment counts in a cycle: not expired, and recurring since before its end or made within it."""
    live = F.coalesce(expires_at > as_of, F.lit(True))
    return live & (created_at < cycle["end"]) & (recurring | (created_at >= cycle["start"]))


def slots(used: Column, limit: Column) -> Column:
    """(remaining, exhausted) of a limit; null means unlimited."""
    remaining = F.when(limit.isNotNull(), F.greatest(limit - used, F.lit(0)))
    return F.struct(remaining.alias("remaining"), F.coalesce(remaining <= 0, F.lit(False)).alias("exhausted"))


AS_OF = "1998-01-01"
_STATE = f"""state AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 = 0 THEN 'suspended' WHEN o_orderstatus = 'F' THEN 'revoked' WHEN o_orderstatus = 'P' THEN 'paused' WHEN o_orderdate <= TIMESTAMP '{AS_OF}' THEN 'expired' ELSE 'ok' END AS available,
['PUBLIC', 'PASSWORD', 'EMAIL_LIST', 'IDENTIFIED', 'OTHER'][1 + o_orderkey % 5] AS mode, o_custkey % 2 = 0 AS verified, CASE WHEN o_custkey % 3 > 0 THEN ' User' || (o_custkey % 50) || '@d' || (o_custkey % 5) || '.com' END AS email, o_orderkey % 3 <> 0 AS downloads, o_orderkey % 7 <> 0 AS asks FROM orders),
code AS (SELECT *, CASE WHEN available <> 'ok' THEN available WHEN mode = 'PUBLIC' THEN 'ok' WHEN mode = 'PASSWORD' THEN CASE WHEN verified THEN 'ok' ELSE 'password_required' END WHEN mode = 'EMAIL_LIST' THEN CASE WHEN email IS NULL THEN 'identity_required'
WHEN lower(trim(email)) = 'user7@d2.com' OR ends_with(lower(trim(email)), '@d1.com') THEN 'ok' ELSE 'email_not_allowed' END WHEN mode = 'IDENTIFIED' THEN CASE WHEN email IS NULL THEN 'identity_required' ELSE 'ok' END ELSE 'forbidden' END AS code FROM state)"""


def _decided(spark, sf_dir):
    """Orders as shared bundles with a reader each, and the decision on them."""
    o, now = table(spark, sf_dir, "orders"), F.lit(AS_OF).cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "REVOKED").otherwise("PAUSED")
    never = F.lit(None).cast("timestamp_ntz")
    open_ = availability(status, now, F.col("o_orderdate"), never, never, F.col("o_custkey") % 11 == 0)
    mode = F.element_at(F.array(*map(F.lit, ("PUBLIC", "PASSWORD", "EMAIL_LIST", "IDENTIFIED", "OTHER"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    email = F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit(" User"), F.col("o_custkey") % 50, F.lit("@d"), F.col("o_custkey") % 5, F.lit(".com")))
    code = access_code(open_, mode, F.col("o_custkey") % 2 == 0, email, F.array(F.lit("USER7@d2.com")), F.array(F.lit(" D1.com ")))
    return o.select(F.col("o_orderkey").alias("id"), mode.alias("mode"), code.alias("code"), (F.col("o_orderkey") % 3 != 0).alias("downloads"), (F.col("o_orderkey") % 7 != 0).alias("asks"))


@query("access_decision", f"WITH {_STATE} SELECT id, mode, code, code = 'ok' AS allowed FROM code")
def access_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", "mode", "code", (F.col("code") == "ok").alias("allowed"))


@query("download_access", f"WITH {_STATE} SELECT id, CASE WHEN code = 'ok' AND NOT downloads THEN 'download_disabled' ELSE code END AS code FROM code")
def download_access(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", F.when((F.col("code") == "ok") & ~F.col("downloads"), "download_disabled").otherwise(F.col("code")).alias("code"))


@query("ask_access", f"WITH {_STATE} SELECT id, CASE WHEN code = 'ok' AND NOT asks THEN 'forbidden' ELSE code END AS code FROM code")
def ask_access(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", F.when((F.col("code") == "ok") & ~F.col("asks"), "forbidden").otherwise(F.col("code")).alias("code"))


@query("email_allowed", "SELECT c_custkey AS id, lower(trim(e)) = 'user7@d2.com' OR ends_with(lower(trim(e)), '@d1.com') AS allowed FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'd1.com' ELSE 'User' || (c_custkey % 50) || '@D' || (c_custkey % 5) || '.com ' END AS e FROM customer)")
def email_allowed_query(spark, sf_dir):
    email = F.when(F.col("c_custkey") % 7 == 0, "d1.com").otherwise(F.concat(F.lit("User"), F.col("c_custkey") % 50, F.lit("@D"), F.col("c_custkey") % 5, F.lit(".com ")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), email_allowed(email, F.array(F.lit("USER7@d2.com")), F.array(F.lit(" D1.com "))).alias("allowed"))


@query("expires_soon", f"SELECT o_orderkey AS id, o_orderdate > TIMESTAMP '{AS_OF}' AND o_orderdate <= TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY AS soon FROM orders")
def expires_soon_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), expires_soon(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp_ntz")).alias("soon"))


@query("resolve_expiration", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN o_orderdate + INTERVAL 24 HOUR WHEN 2 THEN o_orderdate + INTERVAL 7 DAY WHEN 3 THEN o_orderdate + INTERVAL 30 DAY WHEN 4 THEN TIMESTAMP '2002-01-01' END AS expires_at FROM orders""")
def resolve_expiration_query(spark, sf_dir):
    preset = F.element_at(F.array(*map(F.lit, ("never", "24h", "7d", "30d", "custom"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), resolve_expiration(preset, F.lit("2002-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("expires_at"))


_CYCLE = """cyc AS (SELECT o_orderkey AS id, o_orderdate, CASE WHEN a > DATE '2001-03-30' THEN DATE '2001-02-01' + least(d, 28) - 1 ELSE a END AS s, d FROM (SELECT o_orderkey, o_orderdate, CAST(day(o_orderdate) AS INTEGER) AS d, DATE '2001-03-01' + CAST(day(o_orderdate) AS INTEGER) - 1 AS a FROM orders)),
cycle AS (SELECT id, o_orderdate, CAST(s AS DATE) AS cycle_start, CAST(CASE WHEN month(s) = 2 THEN DATE '2001-03-01' + d - 1 ELSE DATE '2001-04-01' + least(d, 30) - 1 END AS DATE) AS cycle_end FROM cyc)"""


@query("billing_cycle", f"WITH {_CYCLE} SELECT id, cycle_start, cycle_end FROM cycle")
def billing_cycle_query(spark, sf_dir, as_of: str = "2001-03-30"):
    cycle = billing_cycle(F.col("o_orderdate"), F.lit(as_of).cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), cycle["start"].alias("cycle_start"), cycle["end"].alias("cycle_end"))


@query("adj_applies", f"WITH {_CYCLE} SELECT id, id % 4 <> 3 AND o_orderdate < cycle_end AND (id % 2 = 0 OR o_orderdate >= cycle_start) AS applies FROM cycle")
def adj_applies(spark, sf_dir, as_of: str = "2001-03-30"):
    """Adjustments of which some recur and some have expired."""
    now, k = F.lit(as_of).cast("timestamp_ntz"), F.col("o_orderkey")
    expires = F.when(k % 4 == 3, F.lit("2001-01-01").cast("timestamp_ntz"))
    cycle = billing_cycle(F.col("o_orderdate"), F.lit(as_of).cast("date"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), adjustment_applies(F.col("o_orderdate"), expires, k % 2 == 0, cycle, now).alias("applies"))


@query("room_slots", """SELECT tenant, used, CASE WHEN lim IS NOT NULL THEN greatest(lim - used, 0) END AS remaining, coalesce(lim - used <= 0, false) AS exhausted FROM (SELECT o_custkey AS tenant, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS used, CASE WHEN o_custkey % 4 > 0 THEN 5 * (o_custkey % 4) END AS lim FROM orders GROUP BY o_custkey)""")
def room_slots(spark, sf_dir):
    """Live bundles of each tenant that use up a slot, against its limit."""
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("used"))
    state = slots(F.col("used"), F.when(F.col("tenant") % 4 > 0, 5 * (F.col("tenant") % 4)))
    return used.select("tenant", "used", state["remaining"].alias("remaining"), state["exhausted"].alias("exhausted"))


@query("entitlement_merge", """SELECT c_custkey AS tenant, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 500 END, CASE WHEN c_custkey % 3 = 0 THEN 200 END, CASE c_mktsegment WHEN 'BUILDING' THEN 50 ELSE 20 END) AS questions,
coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'advanced' END, CASE c_mktsegment WHEN 'BUILDING' THEN 'full' ELSE 'basic' END) AS analytics, CASE coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'advanced' END, CASE c_mktsegment WHEN 'BUILDING' THEN 'full' ELSE 'basic' END) WHEN 'basic' THEN 0 WHEN 'full' THEN 1 ELSE 2 END AS analytics_rank,
c_mktsegment = 'BUILDING' OR c_custkey IN (1, 2, 3) AS feature_enabled FROM customer""")
def entitlement_merge(spark, sf_dir):
    """Plan, override of the tenant and override at run time, the later given value winning field by field; and whether a feature is on."""
    k, large = F.col("c_custkey"), F.col("c_mktsegment") == "BUILDING"
    questions = F.coalesce(F.when(k % 7 == 0, 500), F.when(k % 3 == 0, 200), F.when(large, 50).otherwise(20))
    analytics = F.coalesce(F.when(k % 5 == 0, "advanced"), F.when(large, "full").otherwise("basic"))
    return table(spark, sf_dir, "customer").select(
        k.alias("tenant"), questions.alias("questions"), analytics.alias("analytics"), analytics_rank(analytics).alias("analytics_rank"), feature_enabled(F.lit(False), F.col("c_mktsegment"), ["BUILDING"], k, [1, 2, 3]).alias("feature_enabled")
    )


def analytics_rank(level: Column) -> Column:
    return F.when(level == "basic", 0).when(level == "full", 1).when(level == "advanced", 2)


def feature_enabled(everywhere: Column, plan: Column, plans: list, tenant: Column, tenants: list) -> Column:
    """On for all, for the plan or for the tenant."""
    return everywhere | plan.isin(*plans) | tenant.isin(*tenants)


@query("safe_path", r"""SELECT doc_id, CASE WHEN regexp_matches(p, '^(/|[A-Za-z]:)') OR list_contains(string_split(p, '/'), '..') OR len(string_split(p, '/')) > 20 OR p = '' THEN NULL ELSE array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), '/') END AS path
FROM (SELECT doc_id, replace(CASE doc_id % 5 WHEN 0 THEN 'a\b/./c' || doc_id WHEN 1 THEN '../' || source WHEN 2 THEN '/etc/' || source WHEN 3 THEN 'C:' || source ELSE repeat('d/', CAST(doc_id % 40 AS INTEGER)) || 'x' END, '\', '/') AS p FROM documents)""")
def safe_path_query(spark, sf_dir):
    k = F.col("doc_id") % 5
    path = F.when(k == 0, F.concat(F.lit("a\\b/./c"), "doc_id")).when(k == 1, F.concat(F.lit("../"), "source")).when(k == 2, F.concat(F.lit("/etc/"), "source")).when(k == 3, F.concat(F.lit("C:"), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", safe_path(path.otherwise(F.concat(F.expr("repeat('d/', int(doc_id % 40))"), F.lit("x")))).alias("path"))


@query("column_letter", """SELECT n, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26) ELSE chr(65 + (n - 703) // 676) || chr(65 + ((n - 703) % 676) // 26) || chr(65 + (n - 703) % 26) END AS letters FROM (SELECT CAST(1 + (p_partkey % 2000) AS INTEGER) AS n FROM part)""")
def column_letter_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 2000 + 1).cast("int").alias("n")).select("n", column_letter(F.col("n")).alias("letters"))


#: First bytes that the query looks at. Fixed values.
_HEADS = ["255044462D", "504B0304", "89504E47", "FFD8FFE0", "4749463839", "424D36", "52494646", "49492A00", "D0CF11E0A1", "0000001866747970", "4D5A90", "CFFAEDFE", "232120", ""]


@query("sniff_kind", f"""SELECT p_partkey AS id, CASE WHEN h LIKE '25504446%' THEN 'PDF' WHEN h LIKE '504B0304%' THEN 'ARCHIVE' WHEN h LIKE 'D0CF11E0%' THEN 'WORD' WHEN h LIKE '89504E47%' OR h LIKE 'FFD8FF%' OR h LIKE '47494638%' OR h LIKE '424D%' OR h LIKE '52494646%' OR h LIKE '49492A00%' OR h LIKE '________66747970%' THEN 'IMAGE' END AS kind,
h LIKE '4D5A%' OR h LIKE 'CFFAEDFE%' AS executable FROM (SELECT p_partkey, {_HEADS!r}[1 + p_partkey % {len(_HEADS)}] AS h FROM part)""")
def sniff_kind_query(spark, sf_dir):
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % len(_HEADS) + 1).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), document_kind(head).alias("kind"), looks_executable(head).alias("executable"))
