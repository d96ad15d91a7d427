"""URL filters: host and path rules first; a ratio of two character language models for what no rule fits.

Only DataFrame and SQL functions.  Both models are variable-order Markov models (orders 0 to 2, each smoothed into the
next lower one) over BASE symbols, so there are BASE^3 weights whatever the input: one array of 1 MB that goes to all
tasks.  A URL is spelled once as an array of its symbols and scored where it is: its rows are neither spread over
characters nor exchanged, so that long URLs cost no more a character than short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 48; 0 is any other ASCII character, WIDE one beyond ASCII, PAD stands before the start, END after the last.
SYMBOLS = LOWER + "0123456789/.-_?=&%:#~+"
WIDE, PAD, END = (len(SYMBOLS) + n for n in (1, 2, 3))
BASE = END + 1
SMOOTH = 4.0
UNIT = 1_000_000
#: Share of held-out accepted URLs that the calibrated threshold may block.
MISSED = 0.05
#: URLs whose md5 begins so set the threshold; the others train the models.
HELD = ("0", "1", "2")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or where there is no '://'."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def spelled(url: Column) -> Column:
    """What the models read of a URL: all that follows the first '://' (host, path, query string, fragment), or the whole text without one, A-Z lowered."""
    at = F.instr(url, "://")
    return F.translate(F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url), F.lit("")), UPPER, LOWER)


def grams(spelled: Column) -> Column:
    """The codes of each character of a text, and of the end, with the two symbols before it; null for a null text."""
    known = lambda c: F.call_function("instr", F.lit(SYMBOLS), c)
    symbols = F.transform(F.split(spelled, ""), lambda c: F.when(F.octet_length(c) > 1, WIDE).otherwise(known(c)))
    symbols = F.when(spelled == "", F.array().cast("array<int>")).otherwise(symbols)
    y = F.concat(F.array(F.lit(PAD)), symbols)
    x = F.slice(F.concat(F.array(F.lit(PAD)), y), F.lit(1), F.size(y))
    before = F.zip_with(x, y, lambda a, b: a * BASE + b)
    return F.zip_with(before, F.concat(symbols, F.array(F.lit(END))), lambda a, z: a * BASE + z)


def weights(trained: DataFrame) -> DataFrame:
    """weights, one row: for each gram the integer weight in 1/UNIT nats, log P(symbol | two before) among accepted less the same among rejected.

    trained: gram and accepted (boolean), one row per character of the training URLs.  Grams never seen get their weight
    from the lower orders; all BASE^3 grams are listed, so no gram lacks a weight and the array's length is fixed.
    """
    spark = trained.sparkSession
    seen = trained.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    all_grams = spark.range(BASE**3).withColumnRenamed("id", "gram")
    counts = all_grams.join(seen, "gram", "left").na.fill(0, ["a", "r"])
    x, y, z = F.expr(f"gram div {BASE * BASE}"), F.expr(f"(gram div {BASE}) % {BASE}"), F.expr(f"gram % {BASE}")
    counts = counts.select("gram", x.alias("x"), y.alias("y"), z.alias("z"), "a", "r")
    for c in ("a", "r"):
        counts = (
            counts.withColumn(f"{c}_xy", F.sum(c).over(Window.partitionBy("y", "x")))
            .withColumn(f"{c}_yz", F.sum(c).over(Window.partitionBy("y", "z")))
            .withColumn(f"{c}_y", F.sum(c).over(Window.partitionBy("y")))
        )
    ends = counts.groupBy("z").agg(F.sum("a").alias("a_z"), F.sum("r").alias("r_z"))
    counts = counts.join(F.broadcast(ends), "z").withColumns({f"{c}_n": ends.agg(F.sum(f"{c}_z")).scalar() for c in "ar"})

    def log_p(c: str) -> Column:
        zero = (F.col(f"{c}_z") + 1.0) / (F.col(f"{c}_n") + float(BASE))
        one = (F.col(f"{c}_yz") + SMOOTH * zero) / (F.col(f"{c}_y") + SMOOTH)
        return F.log((F.col(c) + SMOOTH * one) / (F.col(f"{c}_xy") + SMOOTH))

    each = counts.select("gram", F.round((log_p("a") - log_p("r")) * UNIT).cast("long").alias("weight"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "weight"))), lambda p: p["weight"]).alias("weights"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, weight_sum of every row of pages.

    The rules' own verdicts are the labels: URLs outside HELD train the models, the others set the threshold, the highest
    whole hundredth of a nat per character under which at most MISSED of the accepted held-out URLs lie.  What no rule fits is
    allowed if its log-likelihood difference per character (the end counts as one) reaches the threshold; weight_sum is that
    difference before the division, in 1/UNIT nats, null where a rule decides.  Null URLs are judged as the empty text,
    such without '://' by their whole text.  The models are defined without labels too (all weights 0); without held-out accepted URLs the
    threshold is 0.  URLs are read whole, whatever their length, in time that grows with it.  Repeated rows get a row each; an empty table gives no rows.
    """
    host, path = parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    labelled = base.filter("rule is not null").select((F.col("ruled") == "allow").alias("accepted"), F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD).alias("held"), spelled(F.col("url")).alias("spelled"))
    table_ = weights(labelled.filter("not held").select("accepted", F.explode(grams(F.col("spelled"))).alias("gram")))

    def scored(rows: DataFrame) -> DataFrame:
        """Adds weight_sum and score of spelled, null for null."""
        found = rows.withColumn("grams", grams(F.col("spelled"))).withColumn("weights", table_.scalar())
        total = F.aggregate("grams", F.lit(0).cast("long"), lambda t, g: t + F.get("weights", g))
        return found.withColumn("weight_sum", total).withColumn("score", F.col("weight_sum") / F.size("grams")).drop("grams", "weights", "spelled")

    held = scored(labelled.filter("held and accepted")).select(F.floor(F.col("score") / 10_000.0).cast("long").alias("bin"))
    bins = held.groupBy("bin").agg(F.count("*").alias("n"))
    below = bins.withColumn("below", F.sum("n").over(Window.orderBy("bin")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    cut = below.filter(F.col("below") <= MISSED * F.col("total")).agg(F.coalesce(F.max("bin") * 10_000, F.lit(0)).alias("threshold"))
    out = scored(base.withColumn("spelled", F.when(F.col("rule").isNull(), spelled(F.col("url"))))).withColumn("threshold", cut.scalar())
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"), "weight_sum")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_FITS = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1])))
_KIND = " ".join(f"WHEN '{r}' THEN '{k}'" for k, r in RULES)
_SYMBOL = f"CASE WHEN strlen(substr(t, {{0}}, 1)) > 1 THEN {WIDE} ELSE strpos('{SYMBOLS}', substr(t, {{0}}, 1)) END"
SQL = f"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (SELECT *, regexp_extract(after, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, url, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(after, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE {_FITS} END AS rule, row_number() OVER () AS uid, translate(coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END, ''), '{UPPER}', '{LOWER}') AS t FROM c),
e AS (SELECT *, CASE rule {_KIND} END AS ruled, substr(md5(url), 1, 1) IN ('{"', '".join(HELD)}') AS held FROM d),
pos AS (SELECT uid, ruled, held, t, unnest(range(1, length(t) + 2)) AS i FROM e),
sym AS (SELECT uid, ruled, held, CASE WHEN i > length(t) THEN {END} ELSE {_SYMBOL.format('i')} END AS z,
  CASE WHEN i < 2 THEN {PAD} ELSE {_SYMBOL.format('i - 1')} END AS y, CASE WHEN i < 3 THEN {PAD} ELSE {_SYMBOL.format('i - 2')} END AS x FROM pos),
cnt AS (SELECT x, y, z, count(*) FILTER (ruled = 'allow' AND NOT held) AS a, count(*) FILTER (ruled = 'block' AND NOT held) AS r FROM sym GROUP BY x, y, z),
sums AS (SELECT x, y, z, a, r,
  sum(a) OVER (PARTITION BY x, y) AS a_xy, sum(r) OVER (PARTITION BY x, y) AS r_xy, sum(a) OVER (PARTITION BY y, z) AS a_yz, sum(r) OVER (PARTITION BY y, z) AS r_yz,
  sum(a) OVER (PARTITION BY y) AS a_y, sum(r) OVER (PARTITION BY y) AS r_y, sum(a) OVER (PARTITION BY z) AS a_z, sum(r) OVER (PARTITION BY z) AS r_z,
  sum(a) OVER () AS a_n, sum(r) OVER () AS r_n FROM cnt),
p0 AS (SELECT *, (a_z + 1.0::DOUBLE) / (a_n + {float(BASE)}::DOUBLE) AS a0, (r_z + 1.0::DOUBLE) / (r_n + {float(BASE)}::DOUBLE) AS r0 FROM sums),
p1 AS (SELECT *, (a_yz + {SMOOTH}::DOUBLE * a0) / (a_y + {SMOOTH}::DOUBLE) AS a1, (r_yz + {SMOOTH}::DOUBLE * r0) / (r_y + {SMOOTH}::DOUBLE) AS r1 FROM p0),
w AS (SELECT x, y, z, CAST(round((ln((a + {SMOOTH}::DOUBLE * a1) / (a_xy + {SMOOTH}::DOUBLE)) - ln((r + {SMOOTH}::DOUBLE * r1) / (r_xy + {SMOOTH}::DOUBLE))) * {UNIT}::DOUBLE) AS BIGINT) AS weight FROM p1),
s AS (SELECT uid, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(weight) AS DOUBLE) / count(*) AS score FROM sym JOIN w USING (x, y, z) GROUP BY uid),
bins AS (SELECT CAST(floor(score / 10000.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM s JOIN e USING (uid) WHERE ruled = 'allow' AND held GROUP BY 1),
below AS (SELECT bin, sum(n) OVER (ORDER BY bin) - n AS below, sum(n) OVER () AS total FROM bins),
cut AS (SELECT coalesce(max(bin) * 10000, 0) AS threshold FROM below WHERE below <= {MISSED} * total)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (SELECT threshold FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN rule IS NULL THEN total END AS weight_sum
FROM e JOIN s USING (uid)
"""

QUERIES = {"op7_url_filters": op7_url_filters}
ORACLES = {"op7_url_filters": SQL}
