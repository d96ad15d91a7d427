import pytest
from pyspark.sql import functions as F

from quire.functions import formats as N


def _one(spark, *cols):
    return tuple(spark.range(1).select(*cols).collect()[0])


def test_numbers(spark):
    def letters(n):
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out

    # ten digits for each decimal place, as on old monuments' tables; not the library's subtractive list
    ones, tens, hundreds = (["", a, a + a, a + a + a, a + b, b, b + a, b + a + a, b + a + a + a, a + c] for a, b, c in ("ivx", "xlc", "cdm"))

    def roman(n):
        return "m" * (n // 1000) + hundreds[n // 100 % 10] + tens[n // 10 % 10] + ones[n % 10]

    rows = spark.range(1, 4000).select("id", N.lower_letter(F.col("id")).alias("a"), N.upper_letter(F.col("id")).alias("b"), N.lower_roman(F.col("id")).alias("c"), N.upper_roman(F.col("id")).alias("d")).collect()
    for r in rows:
        assert (r.a, r.b, r.c, r.d) == (letters(r.id), letters(r.id).upper(), roman(r.id), roman(r.id).upper())
    assert _one(spark, N.lower_letter(F.lit(0)), N.lower_roman(F.lit(-1))) == (None, None)
    with pytest.raises(Exception, match="not a positive number"):
        _one(spark, N.lower_roman(F.lit(0), strict=True))


def test_bullets(spark):
    got = _one(spark, *[N.format_bullet(F.lit(k), N.list_token(F.lit(f), F.lit(2))) for k, f in enumerate(("bullet", "decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "other"))])
    assert got == ("--\t", "\t2)\t", "\t\tb)\t", "\t\t\tB)\t", "\t\t\t\tii)\t", "\t\t\t\t\tII)\t", "\t\t\t\t\t\t--\t")


def _properties(**values):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def test_styles(spark):
    style = N.html_style(_properties(strike="", smallCaps="", sz="18", lang="de-DE", vertAlign="subscript", u="wave", color="0a5"))
    got = _one(spark, style, N.html_open(style), N.html_close(style))
    assert len(got[0]) == 4 and got[0][0].startswith('span style="') and set(got[0][1:]) == {"s", "sub", "u"}
    assert all(x in got[0][0] for x in ("color:0a5", "font-size:18pt", "font-variant:small-caps")) and "lang" not in got[0][0]
    assert got[1] == "".join(f"<{x}>" for x in got[0]) and got[2] == "".join(f"</{x.split()[0]}>" for x in reversed(got[0]))
    assert _one(spark, N.html_style(_properties(lang="fr", noProof="")))[0] == []
    more = N.STYLES | {"glow": ("{val}", "mark", "class")}
    assert _one(spark, N.html_style(_properties(glow="warm", i=""), more))[0] == ['mark class="warm"', "i"]
    assert _one(spark, N.html_style(_properties(Heading5="")))[0] == ["h5"]


def test_run_strings(spark):
    runs = F.array(F.struct(F.array(F.lit("b")).alias("html_style"), F.lit("x").alias("text")), F.struct(F.array(F.lit("b")).alias("html_style"), F.lit("").alias("text")))
    none = F.array().cast("array<string>")
    assert _one(spark, N.run_strings(none, runs), N.run_strings(F.array(F.lit("h1")), runs)) == (["<b>x</b>"], ["<h1>", "<b>x</b>", "</h1>"])
    assert _one(spark, N.escape_html(F.lit("a<b>&c"))) == ("a&lt;b&gt;&amp;c",)
