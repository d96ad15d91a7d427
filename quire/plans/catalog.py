"""Queries over the driver's tables, each with the SQL that says the same without packages.

Most build packages from a table, extract them with the whole plan, and must come back to what SQL reads in the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import edit, iterate, views
from ..operators.fragments import Handler
from ..sources import build as B
from ..sources import part_source
from ..sources.packages import save_files
from ..sources.store import shared_dir, written
from .extract import Extraction, gather_properties

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _pars(items: Column) -> Column:
    return B.joined(items, lambda x: B.p(B.r(B.t(x))))


def _docs(df: DataFrame, doc_id: str, body: Column, **more) -> DataFrame:
    """The packages of df's rows, built once: each is then read several times, as files would be."""
    parts = {"document.xml": B.document(body)} | more.pop("parts", {})
    used = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(B.build(used, F.col(doc_id), parts, **more))[0]


def files_of(packages: DataFrame) -> str:
    """The packages as files in the shared folder, which driver and executors see as a folder of their own; its path."""
    folder = f"{shared_dir(packages.sparkSession)}/quire-files-{uuid.uuid4().hex}"
    save_files(packages.withColumn("name", F.concat("doc_id", F.lit(".docx"))), folder.removeprefix("file://"), "name", "content")
    return folder


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def _ordered(df: DataFrame, key, by: list[str], value: Column, name: str = "items") -> DataFrame:
    """key and an array of values in order: the rows of one package."""
    return df.groupBy(*(key if isinstance(key, list) else [key])).agg(F.sort_array(F.collect_list(F.struct(*by, value.alias("v")))).getField("v").alias(name))


@query("SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents")
def s1_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 S2 S9 A T1-T3 G2: one paragraph for each line."""
    d = _table(spark, sf_dir, "documents")
    return _long(Extraction(_docs(d, "doc_id", _pars(_lines()))).text)


@query("SELECT doc_id, 0 AS i, 0 AS j, 0 AS k, CAST(p.n - 1 AS INTEGER) AS l, string_split(text, chr(10))[p.n] AS item FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) p")
def i10_enum_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.array(F.array(F.array(_lines()))).alias("tables"))
    return iterate.enum_paragraphs(d)


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_paragraphs, CAST(1 AS BIGINT) AS n_cells, CAST(1 AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_tables FROM documents")
def i1_enum_at_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1-I9 over the nested table of the whole extraction."""
    d = _table(spark, sf_dir, "documents")
    nested, _ = written(iterate.nest(Extraction(_docs(d, "doc_id", _pars(_lines()))).document, "text"))  # it is read four times
    out = None
    for name, f in (("n_paragraphs", iterate.iter_paragraphs), ("n_cells", iterate.enum_cells), ("n_rows", iterate.iter_rows), ("n_tables", iterate.enum_tables)):
        n = f(nested).groupBy("doc_id").agg(F.count("*").alias(name))
        out = n if out is None else out.join(n.hint("merge"), "doc_id")
    return _long(out)


@query("SELECT doc_id, text FROM documents")
def t5_soft_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    body = B.p(B.r(F.array_join(F.transform(_lines(), B.t), "<w:br/>")))
    return _long(Extraction(_docs(d, "doc_id", body)).text)


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents")
def t3_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return _long(Extraction(_docs(d, "doc_id", B.p(B.r(B.t(F.col("text"))))), html=True).text)


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS l, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS INTEGER) AS n_runs, text FROM conversations")
def m1_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3: every turn is chopped into runs of seven characters, with a bookmark between some, and comes back as one run."""
    c = _table(spark, sf_dir, "conversations")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 7).cast("int")), lambda n: F.substring("text", n * 7 + 1, F.lit(7)))
    par = B.p(F.array_join(F.transform(pieces, lambda x: B.r(B.t(x))), '<w:bookmarkStart w:id="1"/>'))
    e = Extraction(_docs(_ordered(c, "conv_id", ["turn"], par), "conv_id", F.array_join("items", "")))
    return _long(e.document.select("doc_id", "l", F.size("run_strings").alias("n_runs"), "text"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'b' WHEN 'A' THEN 'i' ELSE 'u' END AS s FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s) AS n FROM a),
b AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY l_orderkey ORDER BY n) THEN 0 ELSE 1 END AS f FROM o),
c AS (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM b)
SELECT l_orderkey AS doc_id, CAST(g - 1 AS INTEGER) AS m, '<' || any_value(s) || '>' || string_agg(l_partkey || ';', '' ORDER BY n) || '</' || any_value(s) || '>' AS run FROM c GROUP BY l_orderkey, g
""")
def m1_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, F2: neighbouring runs of one format join, others do not."""
    li = _table(spark, sf_dir, "lineitem").withColumn("s", F.when(F.col("l_returnflag") == "R", "b").when(F.col("l_returnflag") == "A", "i").otherwise("u"))
    run = B.r(B.t(F.concat(F.col("l_partkey").cast("string"), F.lit(";"))), B.cat("<w:", F.col("s"), "/>"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "s", run.alias("v"))
    d = _ordered(rows, "l_orderkey", ["l_linenumber", "l_partkey", "s"], F.col("v"))
    return _long(Extraction(_docs(d, "l_orderkey", B.p(F.array_join("items", ""))), html=True).runs.select("doc_id", "m", "run"))


@query("SELECT CAST(p_partkey // 100 AS BIGINT) AS doc_id, 0 AS i, CAST((p_partkey % 100) // 10 AS INTEGER) AS j, CAST(p_partkey % 10 AS INTEGER) AS k, 0 AS l, p_name AS text, 'document,tbl,tr,tc,p' AS lineage FROM part")
def a_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in grids of ten columns."""
    p = _table(spark, sf_dir, "part").withColumn("n", F.col("p_partkey")).withColumn("doc", F.expr("n div 100")).withColumn("row", F.expr("(n % 100) div 10"))
    rows = _ordered(p, ["doc", "row"], ["n"], B.tc(B.p(B.r(B.t(F.col("p_name")))))).withColumn("tr", B.tr(F.array_join("items", "")))
    d = _ordered(rows, "doc", ["row"], F.col("tr"))
    return _long(Extraction(_docs(d, "doc", B.tbl(F.array_join("items", "")))).document.select("doc_id", "i", "j", "k", "l", "text", F.array_join("lineage", ",").alias("lineage")))


def _nation_rows(spark: SparkSession, sf_dir: str, cell: Column, first: Column | None = None) -> DataFrame:
    """One row for each region: a table row of its nations."""
    n = _table(spark, sf_dir, "nation")
    rows = _ordered(n, "n_regionkey", ["n_nationkey"], cell)
    return rows.join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("tr", B.tr(F.array_join("items", "") if first is None else F.concat(first, F.array_join("items", ""))))


@query("""
WITH c AS (SELECT n_regionkey AS j, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, n_name FROM nation),
r AS (SELECT j, '<tr>' || string_agg('<td><pre>(0, ' || j || ', ' || k || ', 0) ' || n_name || '</pre></td>', '' ORDER BY k) || '</tr>' AS v FROM c GROUP BY j)
SELECT '<html><body><table border="1">' || string_agg(v, '' ORDER BY j) || '</table></body></html>' AS html_map FROM r
""")
def g3_html_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ordered(_nation_rows(spark, sf_dir, B.tc(B.p(B.r(B.t(F.col("n_name")))))).withColumn("doc", F.lit("nations")), "doc", ["n_regionkey"], F.col("tr"))
    return views.html_map(Extraction(_docs(d, "doc", B.tbl(F.array_join("items", "")))).document).select("html_map")


@query("""
WITH c AS (SELECT n_regionkey AS j, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, n_name FROM nation),
r AS (SELECT j, string_agg(n_name, '|' ORDER BY k) AS v, count(*) AS n FROM c GROUP BY j)
SELECT string_agg('|' || v || '|' || CASE WHEN j = 0 THEN chr(10) || '|' || repeat('---|', n) ELSE '' END, chr(10) ORDER BY j) || chr(10) || chr(10) || 'after' AS markdown FROM r
""")
def g5_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and a paragraph."""
    d = _ordered(_nation_rows(spark, sf_dir, B.tc(B.p(B.r(B.t(F.col("n_name")))))).withColumn("doc", F.lit("nations")), "doc", ["n_regionkey"], F.col("tr"))
    body = B.cat(B.tbl(F.array_join("items", "")), "<w:p><w:r><w:t>after</w:t></w:r></w:p>")
    return views.markdown(Extraction(_docs(d, "doc", body)).document).select("markdown")


def _regions(spark: SparkSession, sf_dir: str, duplicate: bool) -> DataFrame:
    """A row for each nation; the region's cell is merged downwards."""
    n = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("top"))
    n = n.join(F.broadcast(first), "n_regionkey")
    head = F.when(F.col("n_nationkey") == F.col("top"), B.tc(B.p(B.r(B.t(F.col("r_name")))), '<w:vMerge w:val="restart"/>')).otherwise(B.tc(B.p(""), "<w:vMerge/>"))
    d = _ordered(n, "n_regionkey", ["n_nationkey"], B.tr(B.cat(head, B.tc(B.p(B.r(B.t(F.col("n_name"))))))))
    e = Extraction(_docs(d, "n_regionkey", B.tbl(F.array_join("items", ""))), duplicate_merged_cells=duplicate)
    return _long(e.document.select("doc_id", "j", "k", "text"))


_VMERGE = """
WITH n AS (SELECT n_regionkey, n_name, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(j AS INTEGER) AS j, 0 AS k, {} AS text FROM n UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(j AS INTEGER), 1, n_name FROM n
"""


@query(_VMERGE.format("r_name"))
def c1_vmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir, True)


@query(_VMERGE.format("CASE WHEN j = 0 THEN r_name ELSE '' END"))
def c1_nodup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir, False)


@query("""
SELECT CAST(s_nationkey AS BIGINT) AS doc_id, 0 AS j, CAST(k AS INTEGER) AS k, 'nation ' || s_nationkey AS text FROM (SELECT DISTINCT s_nationkey FROM supplier), LATERAL (SELECT unnest(range(0, 3)) AS k)
UNION ALL SELECT CAST(s_nationkey AS BIGINT), CAST(n AS INTEGER), CAST(u.k AS INTEGER), CASE u.k WHEN 0 THEN s_name WHEN 1 THEN '' || s_suppkey ELSE 'x' END FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier), LATERAL (SELECT unnest(range(0, 3)) AS k) u
""")
def c2_gridspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading over three columns."""
    s = _table(spark, sf_dir, "supplier")
    cell = lambda c: B.tc(B.p(B.r(B.t(c))))
    d = _ordered(s, "s_nationkey", ["s_suppkey"], B.tr(B.cat(cell(F.col("s_name")), cell(F.col("s_suppkey").cast("string")), cell(F.lit("x")))))
    head = B.tr(B.tc(B.p(B.r(B.t(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))))), '<w:gridSpan w:val="3"/>'))
    return _long(Extraction(_docs(d, "s_nationkey", B.tbl(B.cat(head, F.array_join("items", ""))))).document.select("doc_id", "j", "k", "text"))


def _order_lists(spark: SparkSession, sf_dir: str, **options) -> Extraction:
    """A package for each customer: orders as a list from 3, their lines below as letters."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    top = o.select("o_custkey", "o_orderkey", F.lit(0).alias("line"), F.lit(0).alias("part"), B.p(B.r(B.t(F.col("o_orderkey").cast("string"))), B.numbered("1", "0")).alias("v"))
    sub = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), B.p(B.r(B.t(F.col("l_partkey").cast("string"))), B.numbered("1", "1")).alias("v"))
    d = _ordered(top.unionByName(sub), "o_custkey", ["o_orderkey", "line", "part"], F.col("v"))
    return Extraction(_docs(d, "o_custkey", F.array_join("items", ""), parts={"numbering.xml": B.numbering_xml([("decimal", 3), ("lowerLetter", None)])}), **options)


_LISTS = """
WITH r AS (SELECT o_custkey, o_orderkey, 0 AS line, 0 AS part FROM orders UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, line, part) - 1 AS l FROM r),
n AS (SELECT *, sum(CASE WHEN line = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY l) AS a, l - min(l) OVER (PARTITION BY o_custkey, o_orderkey) AS b FROM x)
"""


@query(_LISTS + "SELECT o_custkey AS doc_id, CAST(l AS INTEGER) AS l, CASE WHEN line = 0 THEN (a + 2) || ')' || chr(9) || o_orderkey ELSE chr(9) || CASE WHEN b > 26 THEN chr(CAST(96 + (b - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + (b - 1) % 26 AS INTEGER)) || ')' || chr(9) || part END AS text FROM n")
def w1_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_order_lists(spark, sf_dir).document.select("doc_id", "l", "text"))


@query(_LISTS + "SELECT o_custkey AS doc_id, CAST(l AS INTEGER) AS l, '1' AS list_id, CASE WHEN line = 0 THEN '' || CAST(a AS BIGINT) ELSE CAST(a AS BIGINT) || ',' || b END AS list_pos FROM n")
def w3_list_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_order_lists(spark, sf_dir).document.select("doc_id", "l", "list_id", F.concat_ws(",", F.col("list_pos").cast("array<string>")).alias("list_pos")))


@query(_LISTS + "SELECT o_custkey AS doc_id, 0 AS i, 0 AS j, 0 AS k, CAST(l AS INTEGER) AS l, CASE WHEN line = 0 THEN '' || CAST(a AS BIGINT) ELSE CAST(a AS BIGINT) || ',' || b END AS list_pos FROM n")
def w1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, W1, W3 by blocks: each part's addresses and counts are the work of many tasks."""
    return _long(_order_lists(spark, sf_dir, part_block=64).document.select("doc_id", "i", "j", "k", "l", F.concat_ws(",", F.col("list_pos").cast("array<string>")).alias("list_pos")))


@query("""
WITH RECURSIVE f AS (SELECT p_partkey + 1 AS n, p_partkey + 1 AS k, '' AS s FROM part UNION ALL SELECT n, (k - 1) // 26, chr(CAST(97 + (k - 1) % 26 AS INTEGER)) || s FROM f WHERE k > 0)
SELECT n, s AS lower_letter, upper(s) AS upper_letter FROM f WHERE k = 0
""")
def n1_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"))
    return p.select("n", formats.lower_letter(F.col("n")).alias("lower_letter"), formats.upper_letter(F.col("n")).alias("upper_letter"))


@query("""
WITH d AS (SELECT p_partkey + 1 AS n FROM part), s AS (SELECT n, repeat('m', n // 1000)
  || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][(n // 100) % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(n // 10) % 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS r FROM d)
SELECT n, r AS lower_roman, upper(r) AS upper_roman, '' || n AS decimal_number, '--' AS bullet FROM s
""")
def n3_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"))
    return p.select("n", formats.lower_roman(F.col("n")).alias("lower_roman"), formats.upper_roman(F.col("n")).alias("upper_roman"), formats.decimal(F.col("n")).alias("decimal_number"), formats.bullet().alias("bullet"))


@query("""SELECT p_partkey AS doc_id, '<span style="color:' || lower(substr(p_type, 1, 3)) || ';font-size:' || p_size || 'pt;text-transform:uppercase"><b><s><sub>' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</sub></s></b></span>' AS text FROM part""")
def f2_run_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F4, P7, P11."""
    p = _table(spark, sf_dir, "part")
    style = B.cat('<w:vertAlign w:val="subscript"/><w:strike/><w:b w:val="0"/><w:caps/><w:rFonts w:ascii="x"/><w:sz w:val="', F.col("p_size").cast("string"), '"/><w:color w:val="', F.lower(F.substring("p_type", 1, 3)), '"/>')
    return _long(Extraction(_docs(p, "p_partkey", B.p(B.r(B.t(F.col("p_name")), style))), html=True).text)


@query("SELECT doc_id, 'Heading1' AS style, '<h1>' || replace(replace(replace(string_split(text, chr(10))[1], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h1>' AS text FROM documents")
def p12_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines are headings."""
    d = _table(spark, sf_dir, "documents")
    body = B.cat(B.p(B.r(B.t(F.get(_lines(), F.lit(0)))), '<w:pStyle w:val="Heading1"/>'), _pars(F.slice(_lines(), 2, F.size(_lines()))))
    return _long(Extraction(_docs(d, "doc_id", body), html=True).headings.select("doc_id", "style", "text"))


_LINK = '<a href="([^"]+)">([^<]+)</a>'


@query(f"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK}', 2) AS t FROM pages)
SELECT page_id AS doc_id, CAST(n.i - 1 AS INTEGER) AS l, h[n.i] AS href, t[n.i] AS text FROM a, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i) n
""")
def p13_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of web pages as hyperlinks, one in each paragraph."""
    pages = _table(spark, sf_dir, "pages")
    pages = pages.withColumn("h", F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).withColumn("t", F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)))
    pages = pages.withColumn("links", F.transform("h", lambda x, n: F.struct(F.concat(F.lit("L"), n.cast("string")).alias("id"), x.alias("target"))))
    body = F.array_join(F.transform("t", lambda x, n: B.p(B.hyperlink(B.r(B.t(x)), F.concat(F.lit("L"), n.cast("string"))))), "")
    e = Extraction(_docs(pages.filter("size(h) > 0"), "page_id", body, links=F.col("links")))
    return _long(e.links.select("doc_id", "l", "href", "text"))


@query("""
WITH s AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS o FROM conversations)
SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY o, turn, text) AS text, CAST(count(DISTINCT o) AS BIGINT) AS n_sections FROM s GROUP BY conv_id
""")
def u1_document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns as header, user's as body, assistant's as footer."""
    c = _table(spark, sf_dir, "conversations")
    par = B.p(B.r(B.t(F.col("text"))))
    of = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text", par.alias("v"))))), lambda x: x["v"]), "")
    user, system = F.col("role") == "user", F.col("role") == "system"
    d = c.groupBy("conv_id").agg(of(system).alias("h"), of(user).alias("b"), of(~user & ~system).alias("f"))
    some = lambda tag, x: F.when(F.col(x) != "", B.root(tag, F.col(x)))
    e = Extraction(_docs(d, "conv_id", F.col("b"), parts={"header1.xml": some("hdr", "h"), "footer1.xml": some("ftr", "f")}))
    return _long(e.text.join(e.document.groupBy("doc_id").agg(F.countDistinct("type").alias("n_sections")), "doc_id"))


@query("SELECT doc_id, 'note ----footnote1--------endnote2----' || chr(10) || chr(10) || 'footnote1)' || chr(9) || 'quality ' || quality || chr(10) || chr(10) || 'endnote2)' || chr(9) || 'toxic ' || toxic AS text FROM labels")
def t8_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as notes."""
    d = _table(spark, sf_dir, "labels")
    body = B.p(B.r(B.cat(B.t(F.lit("note ")), '<w:footnoteReference w:id="1"/><w:endnoteReference w:id="2"/>')))
    note = lambda kind, n, text: B.root(f"{kind}s", B.cat(f'<w:{kind} w:id="{n}">', B.p(B.r(B.t(text))), f"</w:{kind}>"))
    parts = {"footnotes.xml": note("footnote", 1, F.concat(F.lit("quality "), F.col("quality").cast("string"))), "endnotes.xml": note("endnote", 2, F.concat(F.lit("toxic "), F.col("toxic").cast("string")))}
    return _long(Extraction(_docs(d, "doc_id", body, parts=parts)).text)


@query("SELECT doc_id, CASE quality WHEN 1 THEN '☒' ELSE '☐' END || CASE toxic WHEN 1 THEN '☒' ELSE '☐' END || '☒' AS text FROM labels")
def t11_checkboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "labels")
    box = lambda inner: B.cat('<w:fldChar w:fldCharType="begin"><w:ffData><w:checkBox>', inner, "</w:checkBox></w:ffData></w:fldChar>")
    body = B.p(B.r(B.cat(box(B.cat('<w:default w:val="0"/><w:checked w:val="', F.col("quality").cast("string"), '"/>')), box(B.cat('<w:default w:val="', F.col("toxic").cast("string"), '"/>')), box("<w:checked/>"))))
    return _long(Extraction(_docs(d, "doc_id", body)).text)


@query("SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'pending' END AS text FROM orders")
def t12_dropdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", '<w:result w:val="1"/>').otherwise('<w:result w:val="2"/>')
    items = "".join(f'<w:listEntry w:val="{x}"/>' for x in ("filled", "open", "pending"))
    body = B.p(B.r(B.cat("<w:ffData><w:ddList>", result, items, "</w:ddList></w:ffData>")))
    return _long(Extraction(_docs(d, "o_orderkey", body)).text)


@query("SELECT n_nationkey AS doc_id, 'a<latex>x=' || n_name || '</latex><span style=font-family:Wingdings>&#x0' || substr('F0' || (10 + n_nationkey), 2) || ';</span>' || chr(9) || '----Image alt text---->' || n_name || '<----media/pic.png----' AS text FROM nation".replace("n_nationkey AS doc_id", "CAST(n_nationkey AS BIGINT) AS doc_id"))
def t4_math_symbols_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T6, T7, T13, T14, J2."""
    n = _table(spark, sf_dir, "nation")
    math = B.cat("<m:oMath><m:r><m:t>x=</m:t></m:r><m:r>", "<m:t>", B.esc(F.col("n_name")), "</m:t></m:r></m:oMath>")
    sym = B.cat('<w:sym w:font="Wingdings" w:char="F0', (F.col("n_nationkey") + 10).cast("string"), '"/>')
    pic = B.cat('<wp:docPr descr="', B.esc(F.col("n_name")), '"/><a:blip r:embed="m0"/><a:blip r:embed="none"/>')
    body = B.p(B.cat(B.r(B.t(F.lit("a"))), math, B.r(B.cat(sym, "<w:tab/>", pic))))
    return _long(Extraction(_docs(n, "n_nationkey", body, media={"pic.png": F.lit(b"png")})).text)


@query("""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
p AS (SELECT a.conv_id, a.n, a.text AS reference, b.text AS remark FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.n = a.n + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS INTEGER) AS ord, '' || n AS id, reference, 'assistant' AS author, '2020-01-01T00:00:00Z' AS date, remark AS text FROM p
""")
def g4_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns commented by the answers."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = _table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).withColumn("next_role", F.lead("role").over(w)).withColumn("next", F.lead("text").over(w))
    hit = (F.col("role") == "user") & (F.col("next_role") == "assistant")
    n = F.col("n").cast("string")
    plain = B.r(B.t(F.col("text")))
    par = B.p(B.cat(F.when(hit, B.cat('<w:commentRangeStart w:id="', n, '"/>')).otherwise(""), plain, F.when(hit, B.cat('<w:commentRangeEnd w:id="', n, '"/>')).otherwise(""), B.r(B.t(F.lit("."))) ))
    remark = B.cat('<w:comment w:id="', n, '" w:author="assistant" w:date="2020-01-01T00:00:00Z">', B.p(B.r(B.t(F.col("next")))), "</w:comment>")
    rows = c.select("conv_id", "n", par.alias("v"), F.when(hit, remark).otherwise("").alias("c"))
    d = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "v", "c"))).alias("rows"))
    of = lambda f: F.array_join(F.transform("rows", lambda x: x[f]), "")
    e = Extraction(_docs(d, "conv_id", of("v"), parts={"comments.xml": B.root("comments", of("c"))}))
    return _long(e.comments)


@query("""
SELECT c_custkey AS doc_id, k.key AS key, CASE k.key WHEN 'title' THEN c_name WHEN 'subject' THEN c_mktsegment ELSE NULL END AS val FROM customer, LATERAL (SELECT unnest(['title', 'subject', 'creator']) AS key) k
""")
def s12_core_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    props = B.core({"dc:title": F.col("c_name"), "dc:subject": F.col("c_mktsegment"), "dc:creator": F.lit("")})
    e = Extraction(_docs(c, "c_custkey", B.p(""), parts={"core.xml": props}))
    return _long(e.core_properties.select("doc_id", F.explode("properties").alias("key", "val")))


@query("SELECT doc_id, 'text.bin' AS name, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, md5(text) AS digest FROM documents")
def s13_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as media members, byte for byte."""
    e = Extraction(_docs(_table(spark, sf_dir, "documents"), "doc_id", B.p(""), media={"text.bin": F.encode("text", "utf-8")}))
    return _long(e.images.select("doc_id", "name", F.length("bytes").alias("n_bytes"), F.md5("bytes").alias("digest")))


@query("SELECT doc_id, replace(replace(replace(text, 'the', 'THE & SO'), 'THE', 'one'), chr(10), chr(10) || chr(10)) AS text FROM documents")
def x2_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replacements in turn over words cut into two runs, saved, and read again."""
    d = _table(spark, sf_dir, "documents")
    halves = lambda x: B.p(B.cat(B.r(B.t(F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int")))), B.r(B.t(F.substring(x, (F.floor(F.length(x) / 2) + 1).cast("int"), F.length(x))))))
    saved = edit.replace_docx_text(_docs(d, "doc_id", B.joined(_lines(), halves)), ("the", "THE & SO"), ("THE", "one"))
    return _long(Extraction(saved).text)


@query("SELECT doc_id, array_to_string([x FOR x IN string_split(text, chr(10)) IF x <> ''], '|') AS text FROM documents")
def i11_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.array(F.array(F.array(_lines()))).alias("tables"))
    kept = d.select("doc_id", iterate.remove_empty_paragraphs(F.col("tables")).alias("tables"))
    return kept.select("doc_id", F.array_join(F.flatten(F.flatten(F.flatten("tables"))), "|").alias("text"))


@query("""
SELECT CAST(r_regionkey AS BIGINT) AS doc_id, v.i AS i, v.t AS is_tbl, v.t AS is_tr, v.t AS is_tc FROM region, LATERAL (SELECT unnest([0, 1, 2]) AS i, unnest([false, true, false]) AS t) v
""")
def p9_table_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, a table, text."""
    reg = _table(spark, sf_dir, "region")
    text = B.p(B.r(B.t(F.col("r_name"))))
    pars = Extraction(_docs(reg, "r_regionkey", B.cat(text, B.tbl(B.tr(B.tc(text))), text))).document
    key = ["doc_id", "i"]
    return _long(iterate.is_tbl(pars, key).join(iterate.is_tr(pars, [*key, "j"]).drop("j"), key).join(iterate.is_tc(pars, [*key, "j", "k"]).drop("j", "k"), key))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS doc_id, k.type AS type, k.path AS path, CAST(count(*) AS BIGINT) AS n FROM nation, LATERAL (SELECT unnest(['officeDocument', 'header', 'hyperlink', 'relationships', 'relationships']) AS type,
  unnest(['word/document.xml', 'word/header1.xml', 'word/http://x/' || n_name, '_rels/.rels', 'word/_rels/document.xml.rels']) AS path) k GROUP BY ALL
""")
def s5_part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a package, by relationship."""
    n = _table(spark, sf_dir, "nation").withColumn("links", F.array(F.struct(F.lit("L0").alias("id"), F.concat(F.lit("http://x/"), F.col("n_name")).alias("target"))))
    e = Extraction(_docs(n, "n_nationkey", B.p(B.r(B.t(F.col("n_name")))), links=F.col("links"), parts={"header1.xml": B.root("hdr", B.p(""))}))
    return _long(e.parts.groupBy("doc_id", "type", "path").agg(F.count("*").alias("n")))


def _word_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables for each document: its lines as rows with their words as cells, and its language."""
    words = F.transform(_lines(), lambda x: F.transform(F.split(x, " ", -1), lambda w: F.array(w)))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array(words, F.array(F.array(F.array("lang")))).alias("tables"))


@query("SELECT doc_id, CAST(t.i AS INTEGER) AS i, CAST(CASE t.i WHEN 0 THEN len(string_split(text, chr(10))) ELSE 1 END AS INTEGER) AS n_rows FROM documents, LATERAL (SELECT unnest([0, 1]) AS i) t")
def i3_iter_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.iter_tables(_word_tables(spark, sf_dir)).select("doc_id", F.get("at", F.lit(0)).alias("i"), F.size("item").alias("n_rows"))


_ROWS = "(SELECT doc_id, CAST(0 AS INTEGER) AS i, CAST(p.n - 1 AS INTEGER) AS j, string_split(string_split(text, chr(10))[p.n], ' ') AS w FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) p UNION ALL SELECT doc_id, 1, 0, [lang] FROM documents)"


@query(f"SELECT doc_id, i, j, CAST(len(w) AS INTEGER) AS n_cells FROM {_ROWS}")
def i8_enum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.enum_rows(_word_tables(spark, sf_dir)).select("doc_id", "i", "j", F.size("item").alias("n_cells"))


@query(f"SELECT doc_id, i, j, CAST(c.n - 1 AS INTEGER) AS k, w[c.n] AS word FROM {_ROWS} r, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS n) c")
def i5_iter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.get("at", F.lit(n))
    return iterate.iter_cells(_word_tables(spark, sf_dir)).select("doc_id", at(0).alias("i"), at(1).alias("j"), at(2).alias("k"), F.get("item", F.lit(0)).alias("word"))


@query("SELECT p_partkey AS doc_id, 0 AS i, 0 AS j, 0 AS k, 0 AS l, '<b>' || p_name || '</b>' || p_brand || '<i>' || p_type || '</i>' AS text FROM part")
def g1_join_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: three runs of different formats, joined."""
    run = lambda c, style="": B.r(B.t(F.col(c)), style)
    e = Extraction(_docs(_table(spark, sf_dir, "part"), "p_partkey", B.p(B.cat(run("p_name", "<w:b/>"), run("p_brand"), run("p_type", "<w:i/>")))), html=True)
    return _long(views.join_runs(e.runs))


_KINDS = "CASE role WHEN 'system' THEN 'header' WHEN 'user' THEN 'body' ELSE 'footer' END"


@query(f"SELECT conv_id AS doc_id, {_KINDS} AS section, CAST(row_number() OVER (PARTITION BY conv_id, {_KINDS} ORDER BY turn, text) - 1 AS INTEGER) AS l, text FROM conversations")
def p10_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: each section by itself."""
    c = _table(spark, sf_dir, "conversations").withColumn("v", B.p(B.r(B.t(F.col("text")))))
    of = lambda *roles: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles), F.struct("turn", "text", "v")))), lambda x: x["v"]), "")
    other = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("role").isin("system", "user"), F.struct("turn", "text", "v")))), lambda x: x["v"]), "")
    d = c.groupBy("conv_id").agg(of("system").alias("h"), of("user").alias("b"), other.alias("f"))
    some = lambda tag, x: F.when(F.col(x) != "", B.root(tag, F.col(x)))
    e = Extraction(_docs(d, "conv_id", F.col("b"), parts={"header1.xml": some("hdr", "h"), "footer1.xml": some("ftr", "f")}))
    out = None
    for kind in ("header", "body", "footer"):
        own = e.section(kind).select("doc_id", F.lit(kind).alias("section"), "l", "text")
        out = own if out is None else out.unionByName(own)
    return _long(out)


@query("""
SELECT CAST(c_custkey AS BIGINT) AS doc_id, s.section AS section, s.i AS i, s.p || c_name || s.q AS text FROM customer,
  LATERAL (SELECT unnest([0, 0, 1, 2, 2, 2]) AS section, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['first ', 'second ', '', 'x ', 'y ', 'z ']) AS p, unnest([' head', ' head', '', ' foot', ' foot', ' foot']) AS q) s
""")
def u2_many_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several headers and footers follow one another in order of their paths; i counts through."""
    par = lambda a, b: B.p(B.r(B.t(F.concat(F.lit(a), F.col("c_name"), F.lit(b)))))
    parts = {"header2.xml": B.root("hdr", par("second ", " head")), "header1.xml": B.root("hdr", par("first ", " head")), "footer3.xml": B.root("ftr", par("z ", " foot")), "footer1.xml": B.root("ftr", par("x ", " foot")), "footer2.xml": B.root("ftr", par("y ", " foot"))}
    return _long(Extraction(_docs(_table(spark, sf_dir, "customer"), "c_custkey", par("", ""), parts=parts)).document.select("doc_id", "section", "i", "text"))


@query("SELECT s_suppkey AS doc_id, 'logo ----media/a.png--------media/b.png---- of ' || s_name AS text FROM supplier")
def j3_vml_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the older kind; one without a relationship leaves nothing."""
    shape = lambda i: f'<w:pict><v:shape><v:imagedata r:id="{i}"/></v:shape></w:pict>'
    body = B.p(B.cat(B.r(B.t(F.lit("logo "))), B.r(B.cat(shape("m0") + shape("m1") + shape("none"))), B.r(B.t(F.concat(F.lit(" of "), F.col("s_name"))))))
    return _long(Extraction(_docs(_table(spark, sf_dir, "supplier"), "s_suppkey", body, media={"a.png": F.lit(b"a"), "b.png": F.lit(b"b")})).text)


@query("SELECT p_partkey AS doc_id, p_name || p_name || p_type AS text FROM part")
def t17_other_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags without a meaning of their own are looked through, deleted text is not text, and both alternatives are read."""
    text = B.t(F.col("p_name"))
    either = B.cat('<mc:AlternateContent><mc:Choice Requires="wps">', text, "</mc:Choice><mc:Fallback>", text, "</mc:Fallback></mc:AlternateContent>")
    gone = B.cat('<w:del w:id="1"><w:r><w:delText>', B.esc(F.col("p_brand")), "</w:delText></w:r></w:del>")
    kept = B.cat('<w:ins w:id="2"><w:smartTag>', B.r(B.t(F.col("p_type"))), "</w:smartTag></w:ins>")
    return _long(Extraction(_docs(_table(spark, sf_dir, "part"), "p_partkey", B.p(B.cat(B.r(either), gone, kept)))).text)


@query("""
SELECT s_suppkey AS doc_id, CAST(v.k AS INTEGER) AS k, CASE v.k WHEN 0 THEN s_name WHEN 3 THEN 'end' ELSE '' END AS text, CASE WHEN v.k IN (1, 2) THEN 'document,,,,' ELSE 'document,tbl,tr,tc,p' END AS lineage
FROM supplier, LATERAL (SELECT unnest([0, 1, 2, 3]) AS k) v
""")
def p14_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty paragraphs that fill a span when nothing is duplicated."""
    cell = lambda x, style="": B.tc(B.p(B.r(B.t(x))), style)
    body = B.tbl(B.tr(B.cat(cell(F.col("s_name"), '<w:gridSpan w:val="3"/>'), cell(F.lit("end")))))
    e = Extraction(_docs(_table(spark, sf_dir, "supplier"), "s_suppkey", body), duplicate_merged_cells=False)
    return _long(e.document.select("doc_id", "k", "text", F.array_join("lineage", ",").alias("lineage")))


def _part_grids(spark: SparkSession, sf_dir: str) -> Extraction:
    """A package for every hundred parts: a table with a row for every ten."""
    p = _table(spark, sf_dir, "part").withColumn("doc", F.expr("p_partkey div 100")).withColumn("row", F.expr("(p_partkey % 100) div 10"))
    rows = _ordered(p, ["doc", "row"], ["p_partkey"], B.tc(B.p(B.r(B.t(F.col("p_name")))))).withColumn("tr", B.tr(F.array_join("items", "")))
    return Extraction(_docs(_ordered(rows, "doc", ["row"], F.col("tr")), "doc", B.tbl(F.array_join("items", ""))))


_GRID = "(SELECT CAST(p_partkey // 100 AS BIGINT) AS doc_id, (p_partkey % 100) // 10 AS j, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS k, p_name FROM part)"


@query(f"SELECT doc_id, CAST(k AS INTEGER) AS k, p_name AS text FROM {_GRID}")
def x3_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a table extracted alone: addresses start anew."""
    e = _part_grids(spark, sf_dir)
    return _long(e.partial(e.nodes.filter("name = 'w:tr'")).document.select("doc_id", "k", "text"))


@query(f"SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS INTEGER) AS tr, CAST(k AS INTEGER) AS tc, p_name AS text FROM {_GRID}")
def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row and the cell around each text, by their places among their siblings (cells follow no properties here, rows neither)."""
    nodes = _part_grids(spark, sf_dir).nodes
    key = ["doc_id", "path"]
    out = nodes.filter("name = 'w:t'").select(*key, "pre", "text")
    for tag in ("w:tr", "w:tc"):
        place = nodes.filter(F.col("name") == tag).select(*key, F.col("pre").alias("found"), F.col("ord").alias(tag[2:]))
        out = out.join(iterate.nearest(nodes, tag).hint("merge"), [*key, "pre"]).join(place.hint("merge"), [*key, "found"]).drop("found")
    return _long(out.select("doc_id", "tr", "tc", "text"))


@query(f"SELECT doc_id, count(*) AS n_cells, count(*) AS n_texts, count(DISTINCT j) AS n_rows FROM {_GRID} GROUP BY doc_id")
def p3_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children and descendants by qualified name."""
    nodes = _part_grids(spark, sf_dir).nodes
    tables = nodes.filter("name = 'w:tbl'")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = iterate.children(nodes, tables, "w:tr")
    return _long(count(iterate.children(nodes, rows, "w:tc"), "n_cells").join(count(iterate.lookup(nodes, tables, "w:t"), "n_texts"), "doc_id").join(count(rows, "n_rows"), "doc_id"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '!' AS text, 'markup word/document.xml' AS stage, '2 comments or instructions without a tag skipped' AS message FROM nation")
def p1_markup_without_a_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and processing instructions have no name; they are skipped with a warning."""
    body = B.cat("<!-- one -->", B.p(B.cat(B.r(B.t(F.col("n_name"))), "<?two?>", B.r(B.t(F.lit("!"))))))
    e = Extraction(_docs(_table(spark, sf_dir, "nation"), "n_nationkey", body))
    return _long(e.text.join(e.warnings.filter("stage like 'markup%'"), "doc_id").select("doc_id", "text", "stage", "message"))


@query("SELECT count(*) AS n_texts, CAST(0 AS BIGINT) AS n_left FROM nation")
def s3_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: what an extraction wrote is gone when it is closed."""
    with Extraction(_docs(_table(spark, sf_dir, "nation"), "n_nationkey", B.p(B.r(B.t(F.col("n_name")))))) as e:
        n, held = e.text.count(), list(e._held)
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    left = sum(path(x).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(x)) for x in held)
    return spark.createDataFrame([(n, left if held else -1)], "n_texts long, n_left long")


@query("""
SELECT s_suppkey AS doc_id, '--' || chr(9) || s_name || chr(10) || chr(10) || '1)' || chr(9) || 'one' || repeat(chr(10) || chr(10) || 'a', 1) || repeat(chr(10) || chr(10) || s_name, 63) || chr(10) || chr(10) || 'first' AS text, CAST(6 AS BIGINT) AS n_warnings FROM supplier
UNION ALL SELECT 1000000 + s_suppkey, s_name, 0 FROM supplier
""")
def w4_odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are no numbers, and a span of a billion: each package keeps its text and gets warnings, and sound packages beside them are as ever."""
    s = _table(spark, sf_dir, "supplier")
    par = lambda text, level: B.p(B.r(B.t(text)), B.numbered("1", level))
    cell = lambda text, span: B.tc(B.p(B.r(B.t(text))), B.cat('<w:gridSpan w:val="', span, '"/>'))
    drop = F.lit('<w:ffData><w:ddList><w:result w:val=""/><w:result w:val="x"/><w:listEntry w:val="first"/><w:listEntry w:val="second"/></w:ddList></w:ffData>')
    odd = B.cat(par(F.col("s_name"), F.col("s_name")), par(F.lit("one"), "0"), B.tbl(B.tr(B.cat(cell(F.lit("a"), F.col("s_name")), cell(F.col("s_name"), "1000000000")))), B.p(B.r(drop)))
    numbers = B.numbering_xml([("decimal", None)]).replace("<w:numFmt", '<w:start w:val="x"/><w:numFmt')
    both = s.select(F.col("s_suppkey").alias("id"), odd.alias("body"), F.lit(numbers).alias("lists")).unionByName(s.select((F.col("s_suppkey") + 1000000).alias("id"), B.p(B.r(B.t(F.col("s_name")))).alias("body"), F.lit(None).cast("string").alias("lists")))
    e = Extraction(_docs(both, "id", F.col("body"), parts={"numbering.xml": F.col("lists")}))
    n = e.warnings.filter("stage like 'value %'").groupBy("doc_id").agg(F.count("*").alias("n_warnings"))
    return _long(e.text.join(n, "doc_id", "left").select("doc_id", "text", F.coalesce("n_warnings", F.lit(0).cast("long")).alias("n_warnings")))


@query("SELECT doc_id, lang || chr(10) || chr(10) || text || source AS text, 'document,,,,p|document,,,,' AS lineages FROM documents")
def j9_text_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs straight below the body, around a paragraph: they make one paragraph, which stands where the part ends."""
    d = _table(spark, sf_dir, "documents")
    run = lambda c: B.r(B.t(F.col(c)))
    e = Extraction(_docs(d, "doc_id", B.cat(run("text"), B.p(run("lang")), run("source"))))
    named = F.transform("lineages", lambda v: F.array_join(F.transform(v, lambda x: F.coalesce(x, F.lit(""))), ","))
    return _long(e.texts.select("doc_id", "text", F.array_join(named, "|").alias("lineages")))


@query("SELECT doc_id, 'body' || chr(10) || chr(10) || 'footnote1)' || chr(9) || 'q' || quality || chr(10) || chr(10) || 'footnote2)' || chr(9) || 'footnote3)' || chr(9) AS text FROM labels")
def t8_left_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of notes after which no paragraph comes make a paragraph of their own."""
    note = lambda n, inner="": B.cat(f'<w:footnote w:id="{n}">', inner, "</w:footnote>")
    notes = B.root("footnotes", B.cat(note(1, B.p(B.r(B.t(F.concat(F.lit("q"), F.col("quality").cast("string")))))), note(2), note(3)))
    return _long(Extraction(_docs(_table(spark, sf_dir, "labels"), "doc_id", B.p(B.r(B.t(F.lit("body")))), parts={"footnotes.xml": notes})).text)


@query("SELECT s_suppkey AS doc_id, CAST(o AS INTEGER) AS ord, CASE o WHEN 0 THEN '</h1>' WHEN 1 THEN '<b>' || s_name || '</b>' ELSE 'plain' || s_suppkey END AS reference FROM supplier, LATERAL (SELECT unnest([0, 1, 2]) AS o) v")
def g4_comments_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, J7 with html on: an open heading counts its closing tag from the start, so a range within it is one run late; ranges elsewhere are as with html off."""
    s = _table(spark, sf_dir, "supplier")
    span = lambda n, inner: B.cat(f'<w:commentRangeStart w:id="{n}"/>', inner, f'<w:commentRangeEnd w:id="{n}"/>')
    run = lambda text, style="": B.r(B.t(text), style)
    heading = B.p(B.cat(run(F.lit("before")), span(0, run(F.col("s_name")))), '<w:pStyle w:val="Heading1"/>')
    other = B.p(B.cat(span(1, run(F.col("s_name"), "<w:b/>")), run(F.lit(" rest")), span(2, run(F.concat(F.lit("plain"), F.col("s_suppkey").cast("string"))))))
    remarks = "".join(f'<w:comment w:id="{n}" w:author="a" w:date="d"><w:p><w:r><w:t>c</w:t></w:r></w:p></w:comment>' for n in range(3))
    e = Extraction(_docs(s, "s_suppkey", B.cat(heading, other), parts={"comments.xml": B.root("comments", F.lit(remarks))}), html=True)
    return _long(e.comments.select("doc_id", "ord", "reference"))


@query("SELECT doc_id, CAST(p.n - 1 AS INTEGER) AS l, lang AS tag, CAST(2 AS INTEGER) AS n_properties, string_split(text, chr(10))[p.n] AS text FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) p")
def p7_content_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag of the content control around each paragraph, searched for upwards."""
    d = _table(spark, sf_dir, "documents")
    body = B.cat('<w:sdt><w:sdtPr><w:alias w:val="a"/><w:tag w:val="old"/><w:tag w:val="', B.esc(F.col("lang")), '"/></w:sdtPr><w:sdtContent>', _pars(_lines()), "</w:sdtContent></w:sdt>")
    e = Extraction(_docs(d, "doc_id", body))
    nodes = e.nodes  # asked for first: one reading serves both
    pars = e.document.select("doc_id", "path", "pre", "l", "text")
    found = gather_properties(nodes, pars, "w:sdt")
    return _long(pars.join(found.hint("merge"), ["doc_id", "path", "pre"]).select("doc_id", "l", F.col("properties")["tag"].alias("tag"), F.size("properties").alias("n_properties"), "text"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name || '[' || n_name || ']' || chr(10) || n_name AS text, CAST(3 AS BIGINT) AS n_runs FROM nation")
def t17_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers by tag: a user's tags emit text, as runs of their own or within the open one; nothing below the second is read."""
    name = F.col("n_name")
    own = B.cat('<w:bookmarkStart w:name="', B.esc(name), '"/>')
    ruby = B.cat('<w:ruby w:base="', B.esc(name), '">', B.r(B.t(F.lit("unread"))), "</w:ruby>")
    handlers = {
        "w:bookmarkStart": Handler(lambda: F.concat(F.lit("["), F.col("attrs")["w:name"], F.lit("]"))),
        "w:ruby": Handler(lambda: F.concat(F.lit("\n"), F.col("attrs")["w:base"]), alone=False, into=False),
    }
    e = Extraction(_docs(_table(spark, sf_dir, "nation"), "n_nationkey", B.p(B.r(B.cat(B.t(name), own, ruby)))), handlers=handlers)
    n = e.document.select("doc_id", F.size("run_strings").cast("long").alias("n_runs"))
    return _long(e.text.join(n, "doc_id"))


@query("SELECT s_suppkey AS doc_id, 'x' || s_name || 'matchx' || s_name || 'y' AS text FROM supplier")
def x1_nested_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is replaced below an element that matches, and one that becomes empty goes with what is below it."""
    name = B.esc(F.col("s_name"))
    text = lambda *inner: B.cat("<w:t>", *inner, "</w:t>")
    apart = "<m:oMath/>"
    body = B.p(B.cat(B.r(text("match", text(name, "match"))), apart, B.r(text("match", name)), apart, B.r(text("gone", text("also gone"))), apart, B.r(text("y"))))
    saved = edit.replace_docx_text(_docs(_table(spark, sf_dir, "supplier"), "s_suppkey", body), ("match", "x"), ("gone", ""))
    return _long(Extraction(saved).text.withColumn("text", F.replace("text", F.lit("<latex></latex>"), F.lit(""))))


@query("""
SELECT c_custkey AS doc_id, '<b>' || c_mktsegment || '</b>: ' || c_name || ' and Pe<b>a</b>rs' || chr(10) || chr(10) || 'Apples' || chr(10) || 'Grapes & <i>Apples' || chr(10) || 'Grapes</i>' AS text FROM customer
""".replace("'Grapes & <i>", "'Grapes &amp; <i>"))
def x2_replace_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with html on: texts of one format are replaced, also across runs, texts of several are left; lines of the new text stand apart by breaks."""
    run = lambda x, style="": B.r(B.t(F.lit(x) if isinstance(x, str) else x), style)
    first = B.p(B.cat(run(F.col("c_mktsegment"), "<w:b/>"), run(": "), run(F.col("c_name")), run(" and Pe"), run("a", "<w:b/>"), run("rs")))
    second = B.p(B.cat(run("Pe"), '<w:bookmarkStart w:id="1"/>', run("ars & "), run("Pea", "<w:i/>"), run("rs", "<w:i/>")))
    saved = edit.replace_docx_text(_docs(_table(spark, sf_dir, "customer"), "c_custkey", B.cat(first, second)), ("Pears", "Apples\nGrapes"), html=True)
    return _long(Extraction(saved, html=True).text)


@query("""
SELECT c_custkey AS doc_id, 'image' AS type, 'word/media/logo.bin' AS path, c_name AS content FROM customer UNION ALL
SELECT c_custkey, 'core-properties', 'docProps/core.xml', c_mktsegment FROM customer
""")
def s2_part_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages as files, of which a scan by ranges reads only the wanted parts."""
    c = _table(spark, sf_dir, "customer")
    made = _docs(c, "c_custkey", B.p(B.r(B.t(F.col("c_name")))), parts={"core.xml": B.core({"dc:title": F.col("c_mktsegment")})}, media={"logo.bin": F.encode("c_name", "utf-8")})
    folder = files_of(made)
    found = part_source.read_parts(spark, folder).filter(F.col("type").isin("image", "core-properties"))
    text = F.decode("bytes", "utf-8")
    title = F.regexp_extract(text, "<dc:title>([^<]*)<", 1)
    return found.select(F.regexp_replace("doc_id", "[.]docx$", "").cast("long").alias("doc_id"), "type", "path", F.when(F.col("type") == "image", text).otherwise(title).alias("content"))
