"""Queries over names, texts and records played by the shared tables, each with its SQL.

Vehicles are customers, revisions their orders (numbered by date), logs and flashes some of these.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dynofleet.functions import units
from dynofleet.functions.equations import compile_equation
from dynofleet.functions.numbers import half_away
from dynofleet.functions.roles import BANKS, PATTERNS
from dynofleet.operators import channels as ch
from dynofleet.operators import history, scrub
from dynofleet.plans.standins import SPARSE_SQL, half_away_sql as half, sparse_log, table
from dynofleet.sources import files, logs, scanner
from dynofleet.sources.tables import written

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---- units: part prices play values, the part number picks the units
UNITS = ["°F", "°C", "kPa", "psi", "inHg", "bar", "g/s", "lb/min", "mph", "km/h"]
PARTNER = ["°C", "°F", "psi", "kPa", "bar", "inHg", "lb/min", "g/s", "km/h", "mph"]
_pick = lambda xs, n=0: F.get(F.array(*map(F.lit, xs)), ((F.col("p_partkey") + n) % len(xs)).cast("int"))
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_UNIT_CTE = f"WITH p AS (SELECT p_partkey, p_retailprice AS v, {_list(UNITS)}[p_partkey % 10 + 1] AS u, {_list(PARTNER)}[p_partkey % 10 + 1] AS w FROM part)"
_FACTOR = "CASE {u} " + " ".join(f"WHEN '{u}' THEN CAST({f!r} AS DOUBLE)" for u, f in units.FACTORS.items()) + " END"


def _convert_sql(offset: str) -> str:
    return half(f"(CASE WHEN u = '°F' THEN (v - {offset}) * 5 / 9 WHEN u = '°C' THEN v * 9 / 5 + {offset} ELSE v * {_FACTOR.format(u='u')} / {_FACTOR.format(u='w')} END)", 6)


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"), _pick(UNITS).alias("u"), _pick(PARTNER).alias("w"))


@query("convert_units", f"{_UNIT_CTE} SELECT p_partkey, {_convert_sql('32')} AS value FROM p")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", half_away(units.convert(F.col("v"), F.col("u"), F.col("w")), 6).alias("value"))


@query("convert_delta", f"{_UNIT_CTE} SELECT p_partkey, {_convert_sql('0')} AS value FROM p")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", half_away(units.convert_delta(F.col("v"), F.col("u"), F.col("w")), 6).alias("value"))


HEADERS = [
    "Time (s)", "Engine Speed (RPM)", "MAF Frequency (Hz)", "LTFT Bank 1 (%)", "Short Term Fuel Trim Bank 1 (%)", "ECT (F)", "Engine Coolant Temp [°C]", "TPS (%)",
    "MAP (kPa)", "Mass Airflow (SAE) [lb/min]", "Mass Airflow Sensor [Hz]", "Spark Advance (deg)", "Knock Retard (deg)", "Closed Loop", "Power Enrichment", "Commanded AFR",
    "WB EQ Ratio 1 [λ]", "MPVI2.1 -> AEM 30", "IAT (degC)", "Boost (psig)", "Vacuum (inHg)", "Rail (bar)", "Speed (mph)", "Speed (km/h)", "Battery (V)", "Odd (furlong)",
]
_RE2 = {r"[°](?!\s*[FC])": r"[°]\s*($|[^\sFC])", r"mass\s*air\s*flow\b(?!.*\[\s*hz\s*\])": None}
_HEAD_CTE = f"WITH h AS (SELECT p_size AS log_id, p_partkey AS ordinal, {_list(HEADERS)}[p_partkey % {len(HEADERS)} + 1] AS header FROM part)"


def _sql_regex(p: str) -> str:
    for java, re2 in _RE2.items():
        p = p.replace(java, re2 or java)
    return "(?i)" + p.replace("'", "''").replace("\\/", "/")


def _role_sql(role: str) -> str:
    tests = []
    for p in PATTERNS[role]:
        if "(?!" in p:
            tests.append("(regexp_matches(header, '(?i)mass\\s*air\\s*flow\\b') AND NOT regexp_matches(header, '(?i)mass\\s*air\\s*flow\\b.*\\[\\s*hz\\s*\\]'))")
        else:
            tests.append(f"regexp_matches(header, '{_sql_regex(p)}')")
    return f"SELECT log_id, '{role}' AS role, ordinal, header FROM h WHERE " + " OR ".join(tests)


_CAND = f"{_HEAD_CTE}, cand AS ({' UNION ALL '.join(map(_role_sql, PATTERNS))})"


def _headers(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("log_id"), F.col("p_partkey").alias("ordinal"), _pick(HEADERS).alias("header"))


def _header_samples(spark, d):
    """Every seventh column is dead."""
    p = table(spark, d, "part").withColumn("row_no", F.lit(1).cast("long"))
    v = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    return p.select(F.col("p_size").alias("log_id"), "row_no", F.col("p_partkey").alias("ordinal"), v.alias("value_num"), F.lit(None).cast("string").alias("value_str"))


_LIVE = f"{_CAND}, live AS (SELECT p_size AS log_id, p_partkey AS ordinal FROM part WHERE p_partkey % 7 <> 0), lc AS (SELECT c.*, row_number() OVER (PARTITION BY c.log_id, role ORDER BY c.ordinal) AS k FROM cand c JOIN live USING (log_id, ordinal)), used AS (SELECT log_id, role, ordinal, header FROM lc WHERE k = 1 OR role IN ('ltft', 'stft'))"


@query("detect_unit", f"{_HEAD_CTE}, t AS (SELECT ordinal, header, trim(regexp_extract(header, '[(\\[]([^)\\]]{{1,12}})[)\\]]\\s*$', 1)) AS b, regexp_matches(header, '[(\\[]([^)\\]]{{1,12}})[)\\]]\\s*$') AS has FROM h) SELECT ordinal, header, CASE WHEN NOT has THEN NULL " + " ".join(f"WHEN regexp_matches(b, '{_sql_regex(p)}') THEN '{u}'" for p, u in units.SPELLINGS) + " ELSE b END AS unit FROM t")
def _(spark, d):
    return _headers(spark, d).select("ordinal", "header", units.detect_unit(F.col("header")).alias("unit"))


@query("preferred_unit", f"{_UNIT_CTE} SELECT p_partkey, CASE WHEN u IN ('°F','°C') THEN '°C' WHEN u IN ('kPa','psi','inHg','bar') THEN 'kPa' WHEN u IN ('g/s','lb/min') THEN 'g/s' ELSE 'mph' END AS unit FROM p")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", units.preferred_unit(units.quantity_of(F.col("u")), {"temperature": "°C"}).alias("unit"))


@query("format_value", f"{_UNIT_CTE} SELECT p_partkey, (CASE WHEN f LIKE '%.%' THEN regexp_replace(f, '\\.?0+$', '') ELSE f END) || ' ' || u AS shown FROM (SELECT *, printf('%.2f', floor(v)/4) AS f FROM p)")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", units.format_value(F.floor("v") / 4, F.col("u"), 2).alias("shown"))


@query("flag_on", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 <> 0 ELSE lower(o_orderstatus) IN ('1','true','yes','on','active','enabled') OR o_orderkey % 5 = 1 END AS flag FROM orders")
def _(spark, d):
    number = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 2).cast("double"))
    text = F.when(F.col("o_orderkey") % 5 == 1, F.lit(" Active ")).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", units.flag_on(number, text).alias("flag"))


EQUATIONS = ["X*0.0078125", "(X-128)*0.5", "X/4+10", "-X+5", "X^2/100", ""]


@query("scale_equation", f"SELECT p_partkey, {half('(CASE p_partkey % 6 WHEN 0 THEN p_size * CAST(0.0078125 AS DOUBLE) WHEN 1 THEN (p_size - 128) * CAST(0.5 AS DOUBLE) WHEN 2 THEN p_size / 4 + CAST(10 AS DOUBLE) WHEN 3 THEN CAST(5 - p_size AS DOUBLE) WHEN 4 THEN CAST(p_size * p_size AS DOUBLE) / 100 ELSE CAST(p_size AS DOUBLE) END)', 6)} AS value FROM part")
def _(spark, d):
    x, value = F.col("p_size").cast("double"), F.lit(None).cast("double")
    for i, e in enumerate(EQUATIONS):
        value = F.when(F.col("p_partkey") % 6 == i, compile_equation(e, x)).otherwise(value)
    return table(spark, d, "part").select("p_partkey", half_away(value, 6).alias("value"))


@query("role_candidates", f"{_CAND} SELECT * FROM cand")
def _(spark, d):
    return ch.role_candidates(_headers(spark, d))


@query("detect_roles", f"{_CAND} SELECT log_id, role, min(ordinal) AS first, CASE WHEN role IN ({', '.join(repr(b) for b in BANKS)}) THEN count(*) ELSE 1 END AS n FROM cand GROUP BY log_id, role")
def _(spark, d):
    return ch.detect_roles(_headers(spark, d)).select("log_id", "role", F.get("ordinals", F.lit(0)).alias("first"), F.size("ordinals").cast("long").alias("n"))


@query("live_channels", f"{_LIVE} SELECT * FROM used")
def _(spark, d):
    return ch.live_channels(_headers(spark, d), _header_samples(spark, d))


@query("silent_channels", f"""{_LIVE}, sup AS (SELECT log_id, role, min_by(header, ordinal) AS superseded FROM used GROUP BY log_id, role),
dead AS (SELECT c.log_id, c.role, c.header, s.superseded, row_number() OVER (PARTITION BY c.log_id, c.role ORDER BY c.ordinal) AS k FROM cand c LEFT JOIN live l USING (log_id, ordinal) LEFT JOIN sup s ON s.log_id = c.log_id AND s.role = c.role WHERE l.ordinal IS NULL)
SELECT log_id, role, header, superseded FROM dead WHERE (superseded IS NULL AND k = 1) OR (superseded IS NOT NULL AND role NOT IN ('ltft', 'stft'))""")
def _(spark, d):
    return ch.silent_channels(_headers(spark, d), _header_samples(spark, d))


@query("empty_channels", f"{_LIVE} SELECT h.log_id, h.ordinal, h.header FROM h LEFT JOIN live l USING (log_id, ordinal) WHERE l.ordinal IS NULL")
def _(spark, d):
    return ch.empty_channels(_headers(spark, d), _header_samples(spark, d))


@query("missing_roles", f"{_LIVE}, need AS (SELECT DISTINCT log_id, unnest(['maf_hz','ltft','stft','ect','closed_loop','pe','tps','rpm']) AS role FROM h) SELECT n.log_id, n.role FROM need n LEFT JOIN (SELECT DISTINCT log_id, role FROM used) u USING (log_id, role) WHERE u.role IS NULL")
def _(spark, d):
    return ch.missing_roles(_headers(spark, d), _header_samples(spark, d))


@query("bank_average", f"{_LIVE} SELECT u.log_id, 1::BIGINT AS row_no, u.role, {half('(CAST(sum(CAST(p_retailprice AS DECIMAL(18,6))) AS DOUBLE) / count(*))', 4)} AS value FROM used u JOIN part p ON p.p_size = u.log_id AND p.p_partkey = u.ordinal GROUP BY u.log_id, u.role")
def _(spark, d):
    used = ch.live_channels(_headers(spark, d), s := _header_samples(spark, d))
    return ch.bank_average(used, s).withColumn("value", half_away(F.col("value"), 4))


@query("log_density", "SELECT log_id, rows, round(CAST(filled AS DOUBLE) / (rows * headers), 3) AS density, CAST(filled AS DOUBLE) / (rows * headers) < 0.9 AS sparse FROM (SELECT p_size AS log_id, CAST(1 AS BIGINT) AS rows, count(*) AS headers, count(*) FILTER (p_partkey % 7 <> 0) AS filled FROM part GROUP BY p_size)")
def _(spark, d):
    return ch.log_density(_headers(spark, d), _header_samples(spark, d))


# ---- records: customers are vehicles, orders revisions
_REV_CTE = """WITH o AS (SELECT o_custkey AS vehicle, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
r AS (SELECT vehicle, printf('v%03d', n) AS rev, n, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus FROM o),
flash AS (SELECT DISTINCT vehicle, rev FROM r WHERE o_orderkey % 3 = 0),
logs AS (SELECT vehicle, CASE WHEN o_orderkey % 7 = 0 THEN printf('v%03d', n + 500) ELSE rev END AS rev FROM r WHERE o_orderkey % 4 <> 0)"""


#: Orders in one task, on average: a task's memory depends on it, not on the table or on how well its rows compress.
ORDERS_A_TASK = 500_000


def _revisions(spark, d):
    """Every step by vehicle goes on with this one exchange, so distinct revisions are found in tasks of the same bounded size."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("vehicle"), "o_orderkey", "o_orderdate")
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ORDERS_A_TASK))
    n = F.row_number().over(Window.partitionBy("vehicle").orderBy("o_orderdate", "o_orderkey"))
    numbered = rows.repartition(tasks, "vehicle").select("vehicle", "o_orderkey", n.alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return numbered.withColumn("rev", F.format_string("v%03d", "n"))


def _flashes(spark, d):
    r = _revisions(spark, d).filter("o_orderkey % 3 = 0")
    return r.select("vehicle", "date", "rev", F.lit("PCM Hammer").alias("adapter"), F.when(F.col("n") % 2 == 0, "—").otherwise("idle").alias("notes"))


def _files(spark, d):
    """Names built the way the records name them, read back by the operators."""
    r = _revisions(spark, d)
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat("date", F.format_string("_v%03d_pull.csv", F.col("n") + 500))).otherwise(F.concat_ws("_", "date", "rev", F.lit("pull.csv")))
    tunes = r.select("vehicle", F.lit("tune").alias("kind"), F.explode(F.array(F.concat_ws("_", "rev", "date", F.lit("street.bin")), F.concat_ws("_", "rev", "date", F.lit("street.hpt")))).alias("name"))
    logs = r.filter("o_orderkey % 4 <> 0").select("vehicle", F.lit("datalog").alias("kind"), name.alias("name"))
    stock = r.filter("n = 1").select("vehicle", F.lit("stock").alias("kind"), F.concat(F.lit("stock_"), "date", F.lit("_read.bin")).alias("name"))
    return tunes.unionByName(logs).unionByName(stock)


@query("revisions_never_flashed", f"{_REV_CTE} SELECT r.vehicle, r.rev FROM r LEFT JOIN flash f USING (vehicle, rev) WHERE f.rev IS NULL")
def _(spark, d):
    return history.revisions_never_flashed(_revisions(spark, d), _flashes(spark, d))


def _named_logs(spark, d):
    return history.parse_names(_files(spark, d)).filter("kind = 'datalog'")


@query("revisions_without_logs", f"{_REV_CTE} SELECT r.vehicle, r.rev FROM r LEFT JOIN (SELECT DISTINCT * FROM logs) l USING (vehicle, rev) WHERE l.rev IS NULL")
def _(spark, d):
    return history.revisions_without_logs(_revisions(spark, d), _named_logs(spark, d))


@query("orphan_log_revs", f"{_REV_CTE} SELECT DISTINCT l.vehicle, l.rev FROM logs l LEFT JOIN r USING (vehicle, rev) WHERE r.rev IS NULL")
def _(spark, d):
    return history.orphan_log_revs(_revisions(spark, d), _named_logs(spark, d))


@query("next_revision", f"{_REV_CTE} SELECT vehicle, printf('v%03d', max(n) + 1) AS next FROM r GROUP BY vehicle")
def _(spark, d):
    return history.next_revision(_revisions(spark, d))


@query("parse_names", f"""{_REV_CTE} SELECT vehicle, kind, date, rev, count(*) AS n FROM (SELECT vehicle, 'tune' AS kind, date, rev FROM r UNION ALL SELECT vehicle, 'tune', date, rev FROM r UNION ALL SELECT vehicle, 'stock', date, NULL FROM r WHERE n = 1
UNION ALL SELECT vehicle, 'datalog', date, CASE WHEN o_orderkey % 7 = 0 THEN printf('v%03d', n + 500) ELSE rev END FROM r WHERE o_orderkey % 4 <> 0) GROUP BY ALL""")
def _(spark, d):
    return history.parse_names(_files(spark, d)).groupBy("vehicle", "kind", "date", "rev").agg(F.count("*").alias("n"))


_TIMELINE = f"""{_REV_CTE}, ev AS (
SELECT vehicle, date, 'baseline' AS type, 1 AS o, NULL AS rev, 'Baseline archived' AS title, 'stock_' || date || '_read.bin' AS detail, 'stock_' || date || '_read.bin' AS name FROM r WHERE n = 1
UNION ALL SELECT vehicle, date, 'revision', 2, rev, rev || ' checked in', rev || '_' || date || '_street.bin, ' || rev || '_' || date || '_street.hpt', rev || '_' || date || '_street.bin' FROM r
UNION ALL SELECT vehicle, date, 'datalog', 3, lr, 'Datalog captured', date || '_' || lr || '_pull.csv', date || '_' || lr || '_pull.csv' FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN printf('v%03d', n + 500) ELSE rev END AS lr FROM r WHERE o_orderkey % 4 <> 0)
UNION ALL SELECT vehicle, date, 'flash', 5, rev, 'Flashed ' || rev, CASE WHEN n % 2 = 0 THEN 'PCM Hammer' ELSE 'PCM Hammer · idle' END, date || '|' || rev FROM r WHERE o_orderkey % 3 = 0)"""


@query("timeline", f"{_TIMELINE} SELECT vehicle, date, type, rev, title, detail, CAST(row_number() OVER (PARTITION BY vehicle ORDER BY date DESC, o, name) AS INTEGER) AS seq FROM ev")
def _(spark, d):
    return history.timeline(_files(spark, d), _flashes(spark, d))


@query("timeline_counts", f"{_TIMELINE} SELECT vehicle, " + ", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in ("baseline", "revision", "datalog", "session", "flash")) + ", count(DISTINCT CASE WHEN type = 'flash' THEN rev END) AS flashed FROM ev GROUP BY vehicle")
def _(spark, d):
    return history.timeline_counts(history.timeline(_files(spark, d), _flashes(spark, d))).withColumn("flashed", F.size("flashed").cast("long"))


@query("duplicate_images", "SELECT vehicle, sha256, count(*) AS n FROM (SELECT source AS vehicle, sha256(text) AS sha256 FROM documents) GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    images = table(spark, d, "documents").select(F.col("source").alias("vehicle"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").cast("string").alias("name"))
    return history.duplicate_images(images).select("vehicle", "sha256", F.size("names").cast("long").alias("n"))


@query("vin_check", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'match' ELSE 'mismatch' END AS verdict FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    vin = lambda x: F.concat(F.lit("1ZZTEST99Z"), F.lpad((F.col("c_custkey") + x).cast("string"), 7, "0"))
    profiles = c.select(F.col("c_custkey").alias("vehicle"), F.when(F.col("c_custkey") % 3 == 0, "unset").otherwise(vin(0)).alias("vin"))
    images = c.select(F.col("c_custkey").alias("vehicle"), F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 2 == 0, vin(0)).otherwise(vin(1)).alias("vin"))
    return history.vin_check(images, profiles).select(F.col("vehicle").alias("c_custkey"), "verdict")


# ---- texts: documents with a vehicle number, a notes line and a place put in by doc_id
_VIN_SQL = "'1ZZTEST99Z' || lpad(CAST(doc_id AS VARCHAR), 7, '0')"


def _log_texts(spark, d):
    n = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\nNotes: seen "), F.lit("1ZZTEST99Z"), n, F.lit(" today\nend")).alias("text"))


@query("scrub_vins", f"SELECT doc_id, sha256(replace(text || chr(10) || 'Notes: seen ' || {_VIN_SQL} || ' today' || chr(10) || 'end', {_VIN_SQL}, '<VIN>')) AS scrubbed, CAST(1 AS BIGINT) AS vins FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    t = _log_texts(spark, d)
    return t.select("doc_id", F.sha2(scrub.scrub_vins(F.col("text")).cast("binary"), 256).alias("scrubbed"), F.size(scrub.vins_in(F.col("text"))).cast("long").alias("vins"))


@query("scrub_notes", "SELECT doc_id, sha256(text || chr(10) || 'Notes:' || chr(10) || 'end') AS scrubbed FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return _log_texts(spark, d).select("doc_id", F.sha2(scrub.scrub_notes(F.col("text")).cast("binary"), 256).alias("scrubbed"))


# ---- scanner: conversation turns play labelled entries
_ENT = "e AS (SELECT CAST(conv_id AS VARCHAR) AS source, turn AS seq, CAST(length(text) % 40 AS VARCHAR) AS parameter_id, trim(text) AS label, CASE WHEN turn % 3 > 0 THEN CAST(turn % 3 AS VARCHAR) END AS unit_id FROM conversations WHERE text IS NOT NULL AND trim(text) <> '')"


def _entries(spark, d):
    c = table(spark, d, "conversations").filter("text is not null and trim(text) <> ''")
    return c.select(
        F.col("conv_id").cast("string").alias("source"),
        F.col("turn").alias("seq"),
        (F.char_length("text") % 40).cast("string").alias("parameter_id"),
        F.trim("text").alias("label"),
        F.when(F.col("turn") % 3 > 0, (F.col("turn") % 3).cast("string")).alias("unit_id"),
    )


@query("build_dictionary", f"""WITH {_ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY parameter_id ORDER BY length(label) DESC, source, seq) AS k FROM e)
SELECT parameter_id, max(label) FILTER (k = 1) AS label, count(DISTINCT unit_id) AS n_units, count(DISTINCT source) AS n_sources FROM r GROUP BY parameter_id""")
def _(spark, d):
    return scanner.build_dictionary(_entries(spark, d)).select("parameter_id", "label", F.size("unit_ids").cast("long").alias("n_units"), F.size("sources").cast("long").alias("n_sources"))


@query("decode_channels", f"""WITH {_ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY parameter_id ORDER BY length(label) DESC, source, seq) AS k FROM e)
SELECT p_partkey, CAST(p_partkey % 60 AS VARCHAR) AS parameter_id, r.label, r.label IS NOT NULL AS known FROM part LEFT JOIN r ON r.k = 1 AND r.parameter_id = CAST(p_partkey % 60 AS VARCHAR)""")
def _(spark, d):
    listed = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 60).cast("string").alias("parameter_id"))
    return scanner.decode_channels(listed, scanner.build_dictionary(_entries(spark, d))).select("p_partkey", "parameter_id", "label", "known")


@query("dictionary_override", f"""WITH {_ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY parameter_id ORDER BY length(label) DESC, source, seq) AS k FROM e), g AS (SELECT parameter_id, label FROM r WHERE k = 1),
m AS (SELECT CAST(n_nationkey * 2 AS VARCHAR) AS parameter_id, n_name AS label FROM nation)
SELECT coalesce(g.parameter_id, m.parameter_id) AS parameter_id, coalesce(m.label, g.label) AS label, m.label IS NOT NULL AS is_manual FROM g FULL JOIN m ON g.parameter_id = m.parameter_id""")
def _(spark, d):
    manual = table(spark, d, "nation").select((F.col("n_nationkey") * 2).cast("string").alias("parameter_id"), F.col("n_name").alias("label"))
    return scanner.dictionary_override(scanner.build_dictionary(_entries(spark, d)), manual).select("parameter_id", "label", "is_manual")


_MATH = "m AS (SELECT CAST(o_orderkey AS VARCHAR) || '-' || row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) AS name, '([' || o_orderkey % 37 || '] * [' || o_custkey % 50 || '.92] / [' || o_orderkey % 37 || '])*15' AS expression, CAST(o_orderkey % 37 AS VARCHAR) AS a, CAST(o_custkey % 50 AS VARCHAR) AS b FROM orders)"


def _math(spark, d):
    w = Window.partitionBy("o_orderkey").orderBy("o_custkey")
    a, b = F.col("o_orderkey") % 37, F.col("o_custkey") % 50
    return table(spark, d, "orders").select(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.row_number().over(w).cast("string")).alias("name"), F.concat(F.lit("(["), a, F.lit("] * ["), b, F.lit(".92] / ["), a, F.lit("])*15")).alias("expression"))


@query("math_references", f"WITH {_MATH} SELECT name, a AS parameter_id FROM m UNION SELECT name, b FROM m")
def _(spark, d):
    return scanner.math_references(_math(spark, d))


@query("decode_expression", f"""WITH {_MATH}, dict AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation)
SELECT name, '(' || coalesce('[' || da.label || ']', '[' || a || ']') || ' * ' || coalesce('[' || db.label || ' Hz]', '[' || b || '.92]') || ' / ' || coalesce('[' || da.label || ']', '[' || a || ']') || ')*15' AS decoded,
(CASE WHEN da.id IS NULL THEN 1 ELSE 0 END + CASE WHEN db.id IS NULL AND b <> a THEN 1 WHEN db.id IS NULL AND da.id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_unknown
FROM m LEFT JOIN dict da ON da.id = a LEFT JOIN dict db ON db.id = b""")
def _(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("parameter_id"), F.col("n_name").alias("label"))
    hz = table(spark, d, "nation").filter("n_nationkey = 0").select(F.lit("92").alias("unit_id"), F.lit("Hz").alias("symbol"))
    return scanner.decode_expression(_math(spark, d), labels, hz).select("name", "decoded", F.size("unknown").cast("long").alias("n_unknown"))


@query("rate_summary", "SELECT o_orderpriority AS name, CAST(o_orderkey % 5 * 100 AS BIGINT) AS interval_ms, count(*) AS channels FROM orders GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("00:00:0"), F.format_string("%.7f", (F.col("o_orderkey") % 5) / 10))
    return scanner.rate_summary(o.select(F.col("o_orderpriority").alias("name"), scanner.interval_ms(text).alias("interval_ms")))


# ---- embeddings play one-row tables of images
@query("cell_diff", f"""WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS c, unnest(embedding) AS e FROM embeddings), v AS (SELECT vec_id, c, {half('CAST(e AS DOUBLE)', 1)} AS v FROM c),
q AS (SELECT a.vec_id AS a, b.vec_id AS b, a.c, CASE WHEN a.v <> b.v THEN b.v - a.v END AS delta FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND b.c = a.c),
p AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE WHEN delta IS NULL THEN 1 ELSE 0 END, abs(delta) DESC, c) AS k FROM q)
SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, count(*) AS cells, count(delta) AS changed, coalesce({half("max(delta) FILTER (k = 1)", 4)}, 0.0) AS max_delta, coalesce({half('(CAST(sum(CAST(delta AS DECIMAL(18,6))) AS DOUBLE) / count(delta))', 4)}, 0.0) AS avg_delta FROM p GROUP BY a, b""")
def _(spark, d):
    from dynofleet.sources.definitions import cell_diff

    return cell_diff(*_vector_cells(spark, d)).select("a", "b", "cells", "changed", "max_delta", "avg_delta")


def _vector_cells(spark, d):
    e = table(spark, d, "embeddings")
    cells = e.select(F.col("vec_id").cast("string").alias("image_id"), F.lit("t").alias("table_id"), F.lit(0).cast("long").alias("r"), F.posexplode("embedding").alias("c", "x"))
    cells = cells.select("image_id", "table_id", "r", F.col("c").cast("long").alias("c"), half_away(F.col("x").cast("double"), 1).alias("value"), F.lit(None).cast("string").alias("x_label"), F.lit(None).cast("string").alias("y_label"))
    pairs = e.select(F.col("vec_id").cast("string").alias("a"), (F.col("vec_id") + 1).cast("string").alias("b"))
    return cells, pairs


@query("top_changed_tables", f"""WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS c, unnest(embedding) AS e FROM embeddings), v AS (SELECT vec_id, c, {half('CAST(e AS DOUBLE)', 1)} AS v FROM c)
SELECT CAST(a.vec_id AS VARCHAR) AS a, CAST(b.vec_id AS VARCHAR) AS b, count(*) FILTER (a.v <> b.v) AS changed FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND b.c = a.c GROUP BY ALL HAVING count(*) FILTER (a.v <> b.v) > 0""")
def _(spark, d):
    from dynofleet.sources.definitions import cell_diff, top_changed_tables

    return top_changed_tables(cell_diff(*_vector_cells(spark, d))).select("a", "b", "changed")


@query("ect_threshold", f"{_LIVE} SELECT log_id, CASE WHEN header LIKE '%(F)%' THEN 160.0 ELSE 71.1 END AS threshold FROM used WHERE role = 'ect'")
def _(spark, d):
    return ch.ect_threshold(ch.live_channels(_headers(spark, d), _header_samples(spark, d)))


@query("log_warnings", f"""{_LIVE}, sup AS (SELECT log_id, role, min_by(header, ordinal) AS superseded FROM used GROUP BY log_id, role),
dead AS (SELECT c.log_id, c.role, s.superseded, row_number() OVER (PARTITION BY c.log_id, c.role ORDER BY c.ordinal) AS k FROM cand c LEFT JOIN live l USING (log_id, ordinal) LEFT JOIN sup s ON s.log_id = c.log_id AND s.role = c.role WHERE l.ordinal IS NULL),
told AS (SELECT log_id FROM dead WHERE (superseded IS NULL AND k = 1) OR (superseded IS NOT NULL AND role NOT IN ('ltft', 'stft')) UNION ALL SELECT log_id FROM (SELECT DISTINCT log_id FROM h) WHERE log_id NOT IN (SELECT log_id FROM used WHERE role = 'ect'))
SELECT x.log_id, count(t.log_id) AS warnings FROM (SELECT DISTINCT log_id FROM h) x LEFT JOIN told t USING (log_id) GROUP BY x.log_id""")
def _(spark, d):
    c, v = _headers(spark, d), _header_samples(spark, d)
    return ch.log_warnings(ch.live_channels(c, v), ch.silent_channels(c, v), c).select("log_id", F.size("warnings").cast("long").alias("warnings"))


@query("definition_match", "SELECT doc_id, source AS os_id, (SELECT max(name) FROM (SELECT d2.source AS os, d2.lang || '_' || d2.source || '.xdf' AS name FROM documents d2) n WHERE n.os = documents.source) AS definition FROM documents")
def _(spark, d):
    from dynofleet.sources.definitions import definition_match

    docs = table(spark, d, "documents")
    defs = docs.select(F.col("source").alias("os_id"), F.concat("lang", F.lit("_"), "source", F.lit(".xdf")).alias("name"))
    return definition_match(docs.select("doc_id", F.col("source").alias("os_id")), defs)


# ---- log files written from events and read back: one file a user
def _event_lines(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).alias("k"), F.floor("value").cast("long").alias("v"), (F.col("event_id") % 4).alias("m"))


def _as_files(lines, head):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda r: r["line"])
    return lines.groupBy(F.col("user_id").cast("string").alias("log_id")).agg(F.concat(F.lit(head), F.array_join(rows, "\n")).alias("text"))


_FILE_SQL = "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no, CAST(floor(value) AS BIGINT) AS v, event_id % 4 AS m FROM events)"


@query("read_plain_log", f"{_FILE_SQL} SELECT log_id, row_no, CAST(v AS DOUBLE) AS value, CASE WHEN m > 0 THEN 'state' || m END AS state FROM l")
def _(spark, d):
    lines = _event_lines(spark, d).withColumn("line", F.concat_ws(",", F.col("k").cast("string"), F.col("v").cast("string"), F.when(F.col("m") > 0, F.concat(F.lit("state"), F.col("m").cast("string"))).otherwise("7")))
    _, s = logs.parse_logs(_as_files(lines, "Time,Value,State\ns,rpm,\n"))
    pick = lambda i, c: F.max(F.when(F.col("ordinal") == i, F.col(c)))
    return s.groupBy("log_id", "row_no").agg(pick(1, "value_num").alias("value"), pick(2, "value_str").alias("state"))


@query("read_sectioned_log", f"{_FILE_SQL} SELECT log_id, 'Engine RPM [rpm]' AS header, count(*) FILTER (m > 0) AS n, CAST(sum(v) FILTER (m > 0) AS DOUBLE) AS total FROM l GROUP BY log_id UNION ALL SELECT log_id, 'Coolant (a,b) [°F]', count(*) FILTER (m < 2), CAST(sum(v) FILTER (m < 2) AS DOUBLE) FROM l GROUP BY log_id")
def _(spark, d):
    v = F.col("v").cast("string")
    lines = _event_lines(spark, d).withColumn("line", F.concat_ws(",", F.col("k").cast("string"), F.when(F.col("m") > 0, v).otherwise(""), F.when(F.col("m") < 2, v).otherwise("")))
    head = "HP Tuners CSV Log File\n\n[Channel Information]\n0,12,5\nOffset,Engine RPM,Coolant (a,b)\ns,rpm,°F\n\n[Channel Data]\n"
    c, s = logs.parse_logs(_as_files(lines, head))
    out = c.filter("ordinal > 0").join(s, ["log_id", "ordinal"])
    return out.groupBy("log_id", "header").agg(F.count("value_num").alias("n"), F.sum("value_num").alias("total"))


@query("read_flash_log", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS rev, CASE WHEN o_orderkey % 2 = 0 THEN 'cable' ELSE 'cable · ' || o_orderstatus END AS detail, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    o = table(spark, d, "orders")
    line = F.concat(F.lit("| "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), "o_orderpriority", F.lit(" | cable | "), F.when(F.col("o_orderkey") % 2 == 0, "—").otherwise(F.col("o_orderstatus")), F.lit(" |"))
    rows = files.flash_rows(o.select(line.alias("line")))
    return rows.select("date", "rev", files.flash_detail(F.col("adapter"), F.col("notes")).alias("detail")).groupBy("date", "rev", "detail").agg(F.count("*").alias("n"))


@query("current_state", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'v' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS current_revision, c_mktsegment AS last_flashed FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    rev = F.when(F.col("c_custkey") % 3 == 0, "— (stock)").otherwise(F.concat(F.lit("v"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")))
    text = F.concat(F.lit("# car\n- Current tune revision: "), rev, F.lit("\n- Last flashed: "), "c_mktsegment", F.lit("\n"))
    return c.select("c_custkey", files.current_state(text).alias("s")).select("c_custkey", "s.*")


# Whole texts as logs: a header line in front (with places in every fifth), notes and a vehicle number behind.
_CHECKED = """WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 1 THEN chr(10) || '1ZZTEST99Z' || lpad(CAST(doc_id AS VARCHAR), 7, '0') ELSE '' END || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Notes: idle' ELSE 'Notes:' END AS text FROM documents WHERE text IS NOT NULL)"""


def _checked_logs(spark, d):
    i = F.col("doc_id")
    head = F.when(i % 5 == 0, "Time,RPM,GPS Latitude,GPS Longitude\n").otherwise("Time,RPM,TPS,MAP\n")
    vin = F.when(i % 2 == 1, F.concat(F.lit("\n1ZZTEST99Z"), F.lpad(i.cast("string"), 7, "0"))).otherwise("")
    text = F.concat(head, "text", vin, F.when(i % 3 == 0, "\nNotes: idle").otherwise("\nNotes:"))
    return table(spark, d, "documents").filter("text is not null").select(i.cast("string").alias("log_id"), text.alias("text"))


@query("scrub_check", f"""{_CHECKED}, c AS (SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '\\b[A-HJ-NPR-Z0-9]{{17}}\\b'), lambda v: regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]')))) AS vins,
  len(regexp_extract_all(text, '(?m)^\\s*Notes:[ \\t]*[^\\s].*$')) AS notes, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS places FROM t)
SELECT CAST(doc_id AS VARCHAR) AS log_id, CAST(vins AS INTEGER) AS vins, CAST(notes AS INTEGER) AS notes, CAST(places AS BIGINT) AS places, vins = 0 AND notes = 0 AND places = 0 AS clean FROM c""")
def _(spark, d):
    return scrub.scrub_check(_checked_logs(spark, d))


@query("scrub_location", """WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS log_id, CAST(line_no AS INTEGER) AS line_no, sha256(CASE WHEN doc_id % 5 = 0 THEN CAST(line_no AS VARCHAR) || ',' || replace(line, ',', ';') ELSE CAST(line_no AS VARCHAR) || ',' || replace(line, ',', ';') || ',1.5,2.5' END) AS line FROM t""")
def _(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumn("log_id", F.col("doc_id").cast("string"))
    body = docs.select("doc_id", "log_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    lines = body.select("log_id", "line_no", F.concat_ws(",", F.col("line_no").cast("string"), F.translate("line", ",", ";"), F.lit("1.5,2.5")).alias("line"))
    names = F.when(F.col("doc_id") % 5 == 0, F.array(*map(F.lit, ("Time", "RPM", "GPS Latitude", "GPS Longitude")))).otherwise(F.array(*map(F.lit, ("Time", "RPM", "TPS", "MAP"))))
    channels = docs.select("log_id", F.posexplode(names).alias("ordinal", "header"))
    return scrub.scrub_location(lines, channels).select("log_id", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("line"))


# ---- files played by the tables: JSON and XML texts are built a row, read by the readers' own parsers
def _xml(text):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")


def _dealt_parts(spark, d):
    """Parts, dealt to many tasks: texts made and parsed for each take far more time than reading a table that one task reads."""
    return written(files.dealt(table(spark, d, "part"), "p_partkey"))  # a table, as filters on the texts would go below an exchange


def _layouts(spark, d):
    """name, text: one layout file a part; panes with tables and series as the part's size says."""
    size = F.col("p_size")
    entry = lambda tag, k: F.concat(F.lit(f"<{tag}><Label>"), _xml(F.col("p_name")), F.lit(f" {k}</Label><ParameterID>"), (F.col("p_partkey") % 40 + k).cast("string"), F.lit(f"</ParameterID><Unit>{k}</Unit><Decimals>{k}</Decimals><Maximum>9{k}</Maximum></{tag}>"))
    tables = F.array_join(F.slice(F.array(*(entry("Table", k) for k in range(3))), F.lit(1), (size % 4).cast("int")), "")
    series = F.array_join(F.slice(F.array(*(entry("Series", k) for k in range(5, 7))), F.lit(1), (size % 3).cast("int")), "")
    text = F.concat(F.lit("<DocumentContents><Content ID=\"1\">"), tables, F.lit("</Content><Content ID=\"2\"><Chart>"), series, F.lit("</Chart></Content></DocumentContents>"))
    return _dealt_parts(spark, d).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".layout.xml")).alias("name"), text.alias("text"))


@query("config_counts", "SELECT p_partkey || '.layout.xml' AS name, 'layout' AS kind, CAST(0 AS BIGINT) AS charts, CAST(p_size % 3 AS BIGINT) AS series, CAST(p_size % 4 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS panes FROM part")
def _(spark, d):
    return scanner.config_counts(_layouts(spark, d))


@query("read_scanner_xml", """WITH k AS (SELECT p_partkey, p_name, p_size, unnest([0, 1, 2, 5, 6]) AS k FROM part)
SELECT p_partkey || '.layout.xml' AS source, CAST(CASE WHEN k < 3 THEN k ELSE p_size % 4 + k - 5 END AS INTEGER) AS seq, CAST(p_partkey % 40 + k AS VARCHAR) AS parameter_id, trim(p_name || ' ' || k) AS label, CAST(k AS VARCHAR) AS unit_id, CAST(k AS INTEGER) AS decimals, CAST(90 + k AS DOUBLE) AS maximum
FROM k WHERE (k < 3 AND k < p_size % 4) OR (k >= 5 AND k - 5 < p_size % 3)""")
def _(spark, d):
    return scanner.labelled_entries(_layouts(spark, d)).select("source", "seq", "parameter_id", "label", "unit_id", "decimals", "maximum")


def _scanner_files(spark, d):
    """name, text: one scanner file a part, of each kind in turn; a second chart has no series."""
    k, size = F.col("p_partkey"), F.col("p_size")
    many = lambda tag, most, n: F.array_join(F.slice(F.array(*(F.concat(F.lit(f"<{tag}><Label>"), _xml(F.col("p_name")), F.lit("</Label><ParameterID>"), (k % 40 + j).cast("string"), F.lit(f"</ParameterID></{tag}>")) for j in range(most))), F.lit(1), n.cast("int")), "")
    listed = F.array_join(F.slice(F.array(*(F.concat(F.lit('<Channel ParameterID="'), (k % 40 + j).cast("string"), F.lit(f'" Interval="00:00:0{j}.5"/>')) for j in range(3))), F.lit(1), (size % 4).cast("int")), "")
    texts = [
        ("channels", F.concat(F.lit("<Channels>"), listed, F.lit("</Channels>"))),
        ("charts", F.concat(F.lit("<Charts><Chart>"), many("Series", 2, size % 3), F.lit("</Chart><Chart></Chart></Charts>"))),
        ("graphs", F.concat(F.lit("<Graphs>"), many("Table", 3, size % 4), F.lit("</Graphs>"))),
        ("layout", F.concat(F.lit('<DocumentContents><Content ID="1">'), many("Table", 3, size % 4), F.lit('</Content><Content ID="2"><Chart>'), many("Series", 2, size % 3), F.lit("</Chart></Content></DocumentContents>"))),
        ("mathparameter", F.concat(F.lit('<MathParameter Name="'), _xml(F.col("p_name")), F.lit('" Expression="['), (k % 37).cast("string"), F.lit('] * 2"/>'))),
    ]
    pick = lambda part: F.element_at(F.array(*(part(x) for x in texts)), (k % 5 + 1).cast("int"))
    return _dealt_parts(spark, d).select(F.concat(k.cast("string"), F.lit("."), pick(lambda x: F.lit(x[0])), F.lit(".xml")).alias("name"), pick(lambda x: x[1]).alias("text"))


@query("scanner_files", """WITH p AS (SELECT *, p_partkey % 5 AS m, p_size % 4 AS t, p_size % 3 AS s, ['channels', 'charts', 'graphs', 'layout', 'mathparameter'][p_partkey % 5 + 1] AS f FROM part)
SELECT p_partkey || '.' || f || '.xml' AS name, CASE WHEN m = 4 THEN 'math' ELSE f END AS kind, CAST(CASE WHEN m = 1 THEN 2 ELSE 0 END AS BIGINT) AS charts, CAST(CASE WHEN m IN (1, 3) THEN s ELSE 0 END AS BIGINT) AS series,
CAST(CASE WHEN m IN (2, 3) THEN t ELSE 0 END AS BIGINT) AS tables, CAST(CASE WHEN m = 3 THEN 2 ELSE 0 END AS BIGINT) AS panes, CASE WHEN m = 4 THEN p_name END AS title, CASE WHEN m = 4 THEN '[' || p_partkey % 37 || '] * 2' END AS expression,
array_to_string(CASE WHEN m = 0 THEN list_transform(range(0, t), lambda j: p_partkey % 40 + j) ELSE [] END, ',') AS channels, CAST(CASE WHEN m = 0 THEN list_sum(list_transform(range(0, t), lambda j: 1000 * j + 500)) END AS BIGINT) AS interval_ms,
array_to_string(list_concat(CASE WHEN m IN (2, 3) THEN list_transform(range(0, t), lambda j: p_partkey % 40 + j) ELSE [] END, CASE WHEN m IN (1, 3) THEN list_transform(range(0, s), lambda j: p_partkey % 40 + j) ELSE [] END), ',') AS labelled FROM p""")
def _(spark, d):
    interval = F.aggregate(F.filter(F.transform("channels", lambda c: scanner.interval_ms(c["_Interval"])), lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda n, x: n + x)
    return scanner.read_scanner(_scanner_files(spark, d)).select(
        "name", "kind", "charts", "series", "tables", "panes", F.col("math._Name").alias("title"), F.col("math._Expression").alias("expression"),
        F.array_join(F.transform("channels", lambda c: c["_ParameterID"]), ",").alias("channels"), F.when(F.size("channels") > 0, interval).alias("interval_ms"),
        F.array_join(F.transform("entries", lambda e: e["ParameterID"]), ",").alias("labelled"),
    )


_OWN_UNIT = "CASE WHEN NOT has THEN NULL " + " ".join(f"WHEN regexp_matches(b, '{_sql_regex(p)}') THEN '{u}'" for p, u in units.SPELLINGS) + " ELSE b END"


@query("log_summary", f"""{_HEAD_CTE}, t AS (SELECT h.*, p.p_retailprice AS v, trim(regexp_extract(header, '[(\\[]([^)\\]]{{1,12}})[)\\]]\\s*$', 1)) AS b, regexp_matches(header, '[(\\[]([^)\\]]{{1,12}})[)\\]]\\s*$') AS has,
  row_number() OVER (PARTITION BY log_id ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY log_id) AS n_all FROM h JOIN part p ON p.p_partkey = h.ordinal),
u AS (SELECT *, ordinal % 7 <> 0 AS live, {_OWN_UNIT} AS native_unit FROM t WHERE k <= 40)
SELECT log_id, ordinal, header, CAST(live AS BIGINT) AS n, CASE WHEN native_unit = '°F' THEN '°C' ELSE native_unit END AS unit, native_unit, coalesce(native_unit = '°F', FALSE) AS converted,
  CASE WHEN live THEN CASE WHEN native_unit = '°F' THEN {half('((v - 32) * 5 / 9)', 3)} ELSE v END END AS hi, NOT live AS non_numeric, CAST(1 AS BIGINT) AS rows FROM u""")
def _(spark, d):
    from dynofleet.operators.report import log_summary

    return log_summary(_headers(spark, d), _header_samples(spark, d), {"temperature": "°C"}).select("log_id", "ordinal", "header", "n", "unit", "native_unit", "converted", "hi", "non_numeric", "rows")


@query("fleet_quality", """WITH RECURSIVE """ + SPARSE_SQL + """, t AS (SELECT log_id, max(sessions) AS sessions, max(dropped) AS dropped FROM walk GROUP BY log_id)
SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events)) AS logs, (SELECT count(*) FROM events) AS total_rows, (SELECT count(*) FROM normal) AS kept_rows, CAST(0 AS BIGINT) AS unusable_logs, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(dropped) AS BIGINT) AS corrupt_stamps FROM t""")
def _(spark, d):
    from dynofleet.operators import align
    from dynofleet.operators.report import quality_summary

    log = sparse_log(spark, d)
    kept = align.normalize_time(log).groupBy("log_id").agg(F.count("*").alias("kept"))
    tally = log.groupBy("log_id").agg(F.count("*").alias("total")).join(kept, "log_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return quality_summary(tally, align.time_report(log))
