"""Flash images and definitions played by suppliers, each reading with its SQL.

A supplier's image holds its key in the system number, the segments and the block of the vehicle; every fifth
segment and every fourth system checksum is off by one, and every seventh image is cut short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dynofleet.operators import revisions
from dynofleet.plans.standins import table
from dynofleet.sources import definitions, images, logs
from dynofleet.sources.files import session_goal

QUERIES, SQL = {}, {}
SIZE, SHORT = 524288, 100
#: Images of one task, 32 MB.
IMAGES = 64
SEG_AT, SEG_STEP = 0x8000, 0x100
#: Sum of the words of the segment table: low halves of starts and ends.
TABLE_SUM = sum(2 * (SEG_AT + SEG_STEP * i) + SEG_STEP - 1 for i in range(7))


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def _zeros(n: int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.lit(n)))


def _filled(parts: list[tuple[int, Column]], size: int = SIZE) -> Column:
    """``size`` bytes: every part (place, bytes) at its place, zeros between. Zeros are put in row by row, so plans hold no images."""
    whole = F.lit(b"")
    for at, part in parts:
        whole = F.concat(F.rpad(whole, F.lit(at), _zeros(256)), part)
    return F.rpad(whole, F.lit(size), _zeros(256))


def spread(rows: DataFrame) -> DataFrame:
    """A few rows that become images, dealt out over tasks before they do: the file they stand in is one task's, a ten-thousandth of the images."""
    return rows.repartition(max(1, -(-rows.count() // IMAGES)))


def _letters(prefix: str, value: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(value.cast("string"), digits, "0"))


def flash_images(spark: SparkSession, d: str) -> DataFrame:
    """path, content."""
    k = F.col("s_suppkey")
    os_id, version = 12_000_000 + k, _letters("A", k % 10, 1)
    word = lambda text: F.conv(F.hex(text), 16, 10).cast("long")
    halves = lambda v: F.floor(v / 65536).cast("long") + v % 65536
    negative = lambda total: F.pmod(-total, F.lit(65536))
    system = (negative(1 + halves(os_id) + word(version) + TABLE_SUM + 0x4E56) + F.when(k % 4 == 0, 1).otherwise(0)) % 65536
    head = F.concat(_hex(system, 4), F.lit("0001"), _hex(os_id, 8), F.hex(version), F.lit("00" * 10), F.lit("".join(f"{SEG_AT + SEG_STEP * i:08X}{SEG_AT + SEG_STEP * i + SEG_STEP - 1:08X}" for i in range(7))))
    block = F.concat(_zeros(4), F.unhex(_hex(9_000_000 + k, 8)), _letters("SER", k, 9).cast("binary"), _zeros(8), _letters("C", k % 1000, 3).cast("binary"), _zeros(1), _letters("1ZZTEST99Z", k, 7).cast("binary"))
    parts = [(0x500, F.unhex(head)), (0x4000, block), (0x4088, F.unhex(F.lit("A5A0")))]
    for i in range(7):
        cal, seg_version = 90_000_000 + k * 7 + i, _letters("Z", F.lit(i), 1)
        mine = (negative(halves(cal) + word(seg_version)) + F.when((k + i) % 5 == 0, 1).otherwise(0)) % 65536
        parts.append((SEG_AT + SEG_STEP * i, F.unhex(F.concat(_hex(mine, 4), F.lit("0000"), _hex(cal, 8), F.hex(seg_version)))))
    parts.append((0x20000, F.lit("NV").cast("binary")))
    return spread(table(spark, d, "supplier")).select(F.concat(k.cast("string"), F.lit(".bin")).alias("path"), F.when(k % 7 == 0, _zeros(SHORT)).otherwise(_filled(parts)).alias("content"))


_NEG = "((65536 - ({}) % 65536) % 65536)"
_HALVES = "({0} // 65536 + {0} % 65536)"
_VERSION = "(65 * 256 + 48 + k % 10)"
_SYSTEM = _NEG.format(f"1 + {_HALVES.format('(12000000 + k)')} + {_VERSION} + {TABLE_SUM + 0x4E56}")
_SEGMENT = _NEG.format(f"{_HALVES.format('(90000000 + k * 7 + i)')} + 90 * 256 + 48 + i")
_K = f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey || '.bin' AS path, s_suppkey % 7 <> 0 AS good FROM supplier),
sys AS (SELECT *, {_SYSTEM} AS calculated, ({_SYSTEM} + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 65536 AS stored FROM s),
seg AS (SELECT k, path, i, ['{"', '".join(images.SEGMENTS)}'][i + 1] AS name, {_SEGMENT} AS calculated, ({_SEGMENT} + CASE WHEN (k + i) % 5 = 0 THEN 1 ELSE 0 END) % 65536 AS stored FROM (SELECT *, unnest(range(7)) AS i FROM s WHERE good)),
hx AS (SELECT k, path, good, printf('%04X', stored) || '0001' || printf('%08X', 12000000 + k) || printf('%04X', {_VERSION}) AS head,
  printf('%08X', 9000000 + k) || hex('SER' || lpad(CAST(k AS VARCHAR), 9, '0')) || hex('C' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0')) || hex('1ZZTEST99Z' || lpad(CAST(k AS VARCHAR), 7, '0')) AS block FROM sys),
sx AS (SELECT k, i, name, printf('%04X', stored) || printf('%08X', 90000000 + k * 7 + i) AS seg FROM seg),
p AS (SELECT a.path AS a, b.path AS b, a.good AS ga, b.good AS gb, a.k,
  len(list_filter(range(0, len(a.head) // 2), lambda j: substr(a.head, 2 * j + 1, 2) <> substr(b.head, 2 * j + 1, 2))) AS header,
  len(list_filter(range(0, len(a.block) // 2), lambda j: substr(a.block, 2 * j + 1, 2) <> substr(b.block, 2 * j + 1, 2))) AS eeprom FROM hx a JOIN hx b ON b.k = a.k + 1),
q AS (SELECT x.k, x.i, x.name, len(list_filter(range(0, 6), lambda j: substr(x.seg, 2 * j + 1, 2) <> substr(y.seg, 2 * j + 1, 2))) AS changed FROM sx x JOIN sx y ON y.k = x.k + 1 AND y.i = x.i)"""


def query(name: str, sql: str, head: str = _K):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = f"{head} {sql}"
        return f

    return keep


def read(spark: SparkSession, d: str) -> DataFrame:
    return images.analyze_images(flash_images(spark, d))


@query("image_detect", "SELECT path, good AS detected FROM s")
def _(spark, d):
    return flash_images(spark, d).select("path", images.image_detect(F.col("content")).alias("detected"))


@query("image_header", "SELECT path, CASE WHEN good THEN 524288 ELSE 100 END AS length, CASE WHEN good THEN 'P01' END AS kind, good AS detected, CASE WHEN good THEN 12000000 + k END AS os_id, CASE WHEN good THEN 'A' || k % 10 END AS os_version FROM s")
def _(spark, d):
    return read(spark, d).select("path", "length", "kind", "detected", "os_id", "os_version")


@query("os_checksum", "SELECT path, CAST(stored AS INTEGER) AS stored, CAST(calculated AS INTEGER) AS calculated, stored = calculated AS ok FROM sys WHERE good")
def _(spark, d):
    return read(spark, d).filter("detected").select("path", "os_checksum.*")


@query("segment_table", f"SELECT path, name, CAST({SEG_AT} + {SEG_STEP} * i AS BIGINT) AS start, CAST({SEG_STEP} AS BIGINT) AS length, 90000000 + k * 7 + i AS cal_id, 'Z' || i AS version, CAST(stored AS INTEGER) AS stored, CAST(calculated AS INTEGER) AS calculated, stored = calculated AS ok FROM seg")
def _(spark, d):
    return read(spark, d).select("path", F.explode("segments").alias("s")).select("path", "s.name", "s.start", "s.length", "s.cal_id", "s.version", "s.stored", "s.calculated", "s.ok")


@query("image_identity", "SELECT path, '1ZZTEST99Z' || lpad(CAST(k AS VARCHAR), 7, '0') AS vin, 'SER' || lpad(CAST(k AS VARCHAR), 9, '0') AS serial, 'C' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS broadcast_code, 9000000 + k AS hardware_id, 2001 AS eeprom_style FROM s WHERE good")
def _(spark, d):
    return read(spark, d).filter("detected").select("path", "vin", "serial", "broadcast_code", "hardware_id", F.col("eeprom_style").cast("int"))


@query("image_verdict", "SELECT path, CAST(n AS INTEGER) AS failed, CASE WHEN n = 0 THEN 'OK' ELSE n || ' FAILED' END AS verdict FROM (SELECT y.path, count(*) FILTER (g.stored <> g.calculated) + max(CASE WHEN y.stored <> y.calculated THEN 1 ELSE 0 END) AS n FROM sys y JOIN seg g USING (k) GROUP BY y.path)")
def _(spark, d):
    return read(spark, d).filter("detected").select("path", "failed", "verdict")


def compared(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = lambda x: F.concat(x.cast("string"), F.lit(".bin"))
    s = table(spark, d, "supplier")
    pairs = s.join(s.select((k - 1).alias("before")), k == F.col("before")).select(name(k).alias("a"), name(k + 1).alias("b"))
    return images.compare_images(pairs, flash_images(spark, d))


@query("byte_diff", f"SELECT a, b, CASE WHEN ga <> gb THEN {SIZE - SHORT} ELSE header + eeprom + coalesce((SELECT CAST(sum(changed) AS BIGINT) FROM q WHERE q.k = p.k), 0) END AS total_changed, ga <> gb AS size_mismatch FROM p")
def _(spark, d):
    return compared(spark, d).select("a", "b", "total_changed", "size_mismatch")


@query(
    "region_diff",
    """SELECT a, b, 'header' AS name, header AS changed FROM p WHERE ga AND gb UNION ALL SELECT a, b, 'eeprom', eeprom FROM p WHERE ga AND gb UNION ALL SELECT a, b, 'system', 0 FROM p WHERE ga AND gb
    UNION ALL SELECT a, b, name, changed FROM p JOIN q USING (k) WHERE ga AND gb""",
)
def _(spark, d):
    return compared(spark, d).select("a", "b", F.explode("regions").alias("r")).select("a", "b", "r.name", "r.changed")


# ---- definitions: one a nation, tables over the bytes of supplier names
def definition_files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = F.concat(
        F.lit('<XDFFORMAT><XDFHEADER><deftitle>t</deftitle><BASEOFFSET offset="0" subtract="0"/><CATEGORY index="0x0" name="Air"/></XDFHEADER><XDFTABLE uniqueid="0x1"><title>'),
        F.col("n_name"),
        F.lit('</title><CATEGORYMEM index="0" category="1"/><XDFAXIS id="x"><indexcount>3</indexcount><LABEL index="0" value="lo"/><LABEL index="1" value="mid"/><LABEL index="2" value="hi"/></XDFAXIS><XDFAXIS id="y"><indexcount>2</indexcount></XDFAXIS><XDFAXIS id="z"><EMBEDDEDDATA mmedaddress="0x'),
        F.hex(n % 6),
        F.lit('" mmedelementsizebits="16" mmedrowcount="2" mmedcolcount="3" mmedmajorstridebits="0" mmedminorstridebits="0"/><decimalpl>2</decimalpl><MATH equation="X*0.5+'),
        (n % 3).cast("string"),
        F.lit('"/></XDFAXIS></XDFTABLE><XDFCONSTANT uniqueid="0x9"><title>Limit</title><units>rpm</units><EMBEDDEDDATA mmedaddress="'),
        (n + 1).cast("string"),
        F.lit('" mmedelementsizebits="8"/><MATH equation="X*25"/></XDFCONSTANT></XDFFORMAT>'),
    )
    return table(spark, d, "nation").select(n.cast("long").alias("os_id"), text.alias("text"))


@query("read_xdf", "SELECT CAST(n_nationkey AS BIGINT) AS os_id, '0x1' AS table_id, trim(n_name) AS title, x.axis, CAST(CASE x.axis WHEN 'z' THEN n_nationkey % 6 END AS BIGINT) AS address, CASE x.axis WHEN 'x' THEN 3 ELSE 0 END AS labels FROM nation, (VALUES ('x'), ('y'), ('z')) x(axis)", "")
def _(spark, d):
    axes = definitions.read_axes(definitions.parse_definitions(definition_files(spark, d)))
    return axes.select("os_id", "table_id", "title", "axis", "address", F.when(F.col("axis") == "x", F.size("labels")).otherwise(0).alias("labels"))


@query("read_constants", "SELECT CAST(n_nationkey AS BIGINT) AS os_id, '0x9' AS id, 'Limit' AS title, 'rpm' AS units, CAST(n_nationkey + 1 AS BIGINT) AS address, 8 AS bits, 'X*25' AS equation FROM nation", "")
def _(spark, d):
    return definitions.read_constants(definitions.parse_definitions(definition_files(spark, d))).select("os_id", "id", "title", "units", "address", "bits", "equation")


@query(
    "read_cells",
    """SELECT CAST(s_suppkey AS VARCHAR) AS image_id, r, c, raw, ['lo', 'mid', 'hi'][c + 1] AS x_label, raw * CAST(0.5 AS DOUBLE) + s_nationkey % 3 AS value
    FROM (SELECT *, CASE WHEN p + 2 <= length(s_name) THEN CAST(unicode(substr(s_name, p + 1, 1)) * 256 + unicode(substr(s_name, p + 2, 1)) AS BIGINT) END AS raw
      FROM (SELECT *, s_nationkey % 6 + 2 * (3 * r + c) AS p FROM supplier, (SELECT unnest(range(2)) AS r), (SELECT unnest(range(3)) AS c)))""",
    "",
)
def _(spark, d):
    axes = definitions.read_axes(definitions.parse_definitions(definition_files(spark, d)))
    content = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.col("s_nationkey").cast("long").alias("os_id"), F.col("s_name").cast("binary").alias("content"))
    return definitions.read_cells(content, axes).select("image_id", "r", "c", "raw", "x_label", "value")


# ---- revisions: a nation is a vehicle and its system, each supplier a revision that holds the supplier's name at the front, last letter first
@query(
    "compare_revisions",
    f"""WITH s AS (SELECT *, lag(s_suppkey) OVER w AS k0, lag(s_name) OVER w AS n0 FROM (SELECT s_nationkey, s_suppkey, reverse(s_name) AS s_name FROM supplier) WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
    p AS (SELECT s_nationkey AS n, k0, s_suppkey AS k, n0, s_name AS n1, len(list_filter(range(1, length(s_name) + 1), lambda j: substr(s_name, j, 1) <> substr(n0, j, 1))) AS changed FROM s WHERE k0 IS NOT NULL),
    c AS (SELECT n, k, unicode(substr(n0, i + 1, 1)) * 256 + unicode(substr(n0, i + 2, 1)) AS x, unicode(substr(n1, i + 1, 1)) * 256 + unicode(substr(n1, i + 2, 1)) AS y, i FROM (SELECT *, n % 6 + 2 * unnest(range(6)) AS i FROM p)),
    t AS (SELECT n, k, count(*) FILTER (x <> y) AS cells, coalesce(CAST(arg_max(0.5 * (y - x), abs(y - x) * 100 - i) FILTER (x <> y) AS DOUBLE), 0.0) AS max_delta FROM c GROUP BY n, k)
    SELECT CAST(n AS BIGINT) AS vehicle, k0 || '.bin' AS a, k || '.bin' AS b, CAST(changed AS BIGINT) AS total_changed, CAST(changed AS BIGINT) AS header, CAST(changed = 0 AS BOOLEAN) AS identical,
      CASE WHEN cells > 0 THEN 1 ELSE 0 END AS tables_changed, cells AS cells_changed, max_delta FROM p JOIN t USING (n, k)""",
    "",
)
def _(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    name = F.reverse("s_name").cast("binary")
    content = _filled([(0, name), (0x500, F.unhex(F.concat(F.lit("00000001"), _hex(n, 8))))])
    files = spread(table(spark, d, "supplier")).select(n.alias("vehicle"), F.format_string("v%09d.bin", k).alias("name"), F.concat(k.cast("string"), F.lit(".bin")).alias("path"), content.alias("content"))
    axes = definitions.read_axes(definitions.parse_definitions(definition_files(spark, d)))
    header = F.filter("regions", lambda r: r["name"] == "header")[0]["changed"]
    out = revisions.compare_revisions(files, axes)
    return out.select("vehicle", "a", "b", "total_changed", header.alias("header"), "identical", "tables_changed", "cells_changed", F.coalesce(F.get("tables", F.lit(0))["max_delta"], F.lit(0.0)).alias("max_delta"))


# ---- names of sectioned logs, session notes
@query("rejoin_names", "SELECT p_partkey, 'Offset|Coolant (a,b)|' || p_name || ' [x,' || p_size || ']' AS names FROM part", "")
def _(spark, d):
    line = F.concat(F.lit("Offset,Coolant (a,b),"), "p_name", F.lit(" [x,"), F.col("p_size").cast("string"), F.lit("]"))
    names = logs.rejoin_names(logs.split_fields(line), F.lit(3))
    return table(spark, d, "part").select("p_partkey", F.array_join(names, "|").alias("names"))


@query("merge_units", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' [' || p_size || ']' WHEN p_partkey % 3 = 1 THEN p_name || ' [V]' ELSE p_name END AS header FROM part", "")
def _(spark, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 1, F.concat("p_name", F.lit(" [V]"))).otherwise(F.col("p_name"))
    unit = F.when(k == 2, F.lit(" ")).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", logs.merge_units(name, unit).alias("header"))


@query("read_session_notes", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'v' || c_nationkey END AS goal FROM customer", "")
def _(spark, d):
    k = F.col("c_custkey") % 3
    goal = F.when(k == 0, F.concat(F.lit("**Goal for this session:** "), "c_mktsegment")).otherwise(F.lit("**Goal for this session:**"))
    rev = F.when(k == 2, F.lit("")).otherwise(F.concat(F.lit("**Tune revision flashed:** v"), F.col("c_nationkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", session_goal(F.concat_ws("\n", F.lit("# notes"), goal, rev)).alias("goal"))
