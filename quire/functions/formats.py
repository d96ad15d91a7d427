"""Numbering formats (N1-N6, W5, W6) and HTML tags (F1-F4) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens of Roman numerals below a thousand, by falling value.
ROMAN = ((900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def _positive(n: Column, out: Column, strict: bool) -> Column:
    """out for n >= 1; else an error, or null where strict is off."""
    return F.when(n >= 1, out).otherwise(F.raise_error(F.concat(F.lit("not a positive number: "), n.cast("string"))) if strict else F.lit(None).cast("string"))


def lower_letter(n: Column, strict: bool = False) -> Column:
    """1 -> a, 26 -> z, 27 -> aa: bijective base 26.  Seven letters hold any int."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        left = acc["n"] - 1
        return F.when(acc["n"] > 0, F.struct(F.floor(left / 26).cast("long").alias("n"), F.concat(F.char((left % 26 + 97).cast("int")), acc["s"]).alias("s"))).otherwise(acc)

    return _positive(n, F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step)["s"], strict)


def upper_letter(n: Column, strict: bool = False) -> Column:
    """N2."""
    return F.upper(lower_letter(n, strict))


def lower_roman(n: Column, strict: bool = False) -> Column:
    """Thousands are m as often as needed."""
    n = n.cast("long")
    tokens = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(t).alias("t")) for v, t in ROMAN])
    start = F.struct((n % 1000).alias("n"), F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")).alias("s"))
    done = F.aggregate(tokens, start, lambda acc, x: F.struct((acc["n"] % x["v"]).alias("n"), F.concat(acc["s"], F.repeat(x["t"], F.floor(acc["n"] / x["v"]).cast("int"))).alias("s")))
    return _positive(n, done["s"], strict)


def upper_roman(n: Column, strict: bool = False) -> Column:
    """N4."""
    return F.upper(lower_roman(n, strict))


def decimal(n: Column) -> Column:
    """N5."""
    return n.cast("string")


def bullet() -> Column:
    """N6."""
    return F.lit("--")


def list_token(fmt: Column, n: Column) -> Column:
    """The text of a list number; formats that are not known are bullets."""
    return (
        F.when(fmt == "decimal", decimal(n))
        .when(fmt == "lowerLetter", lower_letter(n))
        .when(fmt == "upperLetter", upper_letter(n))
        .when(fmt == "lowerRoman", lower_roman(n))
        .when(fmt == "upperRoman", upper_roman(n))
        .otherwise(bullet())
    )


def format_bullet(ilvl: Column, token: Column) -> Column:
    """A tab for each level, the token, ')' unless it is a bullet, a tab."""
    return F.concat(F.repeat(F.lit("\t"), ilvl.cast("int")), token, F.when(token == "--", "").otherwise(")"), F.lit("\t"))


#: F1. Style name -> (pattern, container, property).  {tag}, {val}, {val3} and {last} stand for the name, the value, its first three
#: characters and the name's last one.  Pass a changed copy to extend it.
STYLES: dict[str, tuple[str, str | None, str | None]] = {
    "b": ("{tag}", None, None),
    "i": ("{tag}", None, None),
    "u": ("{tag}", None, None),
    "strike": ("s", None, None),
    "vertAlign": ("{val3}", None, None),
    "smallCaps": ("font-variant:small-caps", "span", "style"),
    "caps": ("text-transform:uppercase", "span", "style"),
    "highlight": ("background-color:{val}", "span", "style"),
    "sz": ("font-size:{val}pt", "span", "style"),
    "color": ("color:{val}", "span", "style"),
    **{f"Heading{k}": ("h{last}", None, None) for k in range(1, 7)},
}


def html_style(properties: Column, styles: dict | None = None) -> Column:
    """properties (map of name to value or null) to the insides of HTML tags: containers first, then bare tags, each sorted."""
    styles = STYLES if styles is None else styles
    groups: dict[tuple, list[Column]] = {}
    for key, (pattern, container, prop) in styles.items():
        val = F.coalesce(F.element_at(properties, key), F.lit(""))
        filled = F.lit(pattern.replace("{tag}", key).replace("{last}", key[-1]))
        for name, piece in (("{val3}", F.substring(val, 1, 3)), ("{val}", val)):
            if name in pattern:
                filled = F.replace(filled, F.lit(name), piece)
        groups.setdefault((container, prop), []).append(F.when(F.map_contains_key(properties, key), filled))
    some = lambda cols: F.array_sort(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    out = []
    for container in sorted({c for c, p in groups if c and p}):
        props = [F.when(F.size(some(cols)) > 0, F.concat(F.lit(f'{p}="'), F.array_join(some(cols), ";"), F.lit('"'))) for (c, p), cols in sorted(groups.items(), key=str) if c == container and p]
        joined = F.array_join(F.filter(F.array(*props), lambda x: x.isNotNull()), " ")
        out.append(F.when(joined != "", F.array(F.concat(F.lit(container + " "), joined))).otherwise(F.array().cast("array<string>")))
    bare = groups.get((None, None))
    if bare:
        out.append(some(bare))
    none = F.array().cast("array<string>")
    return F.when(properties.isNull(), none).otherwise(F.concat(*out) if out else none)


def html_open(style: Column) -> Column:
    """<a><b>..."""
    return F.array_join(F.transform(style, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")


def html_close(style: Column) -> Column:
    """...</b></a>, first words only."""
    return F.array_join(F.transform(F.reverse(style), lambda x: F.concat(F.lit("</"), F.element_at(F.split(x, " "), 1), F.lit(">"))), "")


def run_string(run: Column) -> Column:
    """A run struct (html_style, text) with its tags; empty without text."""
    return F.when(run["text"] == "", "").otherwise(F.concat(html_open(run["html_style"]), run["text"], html_close(run["html_style"])))


def run_strings(html: Column, runs: Column) -> Column:
    """The strings of a paragraph's runs without empty ones, between its own tags if it has any."""
    inner = F.filter(F.transform(runs, run_string), lambda s: s != "")
    return F.when(F.size(html) > 0, F.concat(F.array(html_open(html)), inner, F.array(html_close(html)))).otherwise(inner)


def escape_html(text: Column) -> Column:
    """& < > escaped, & first."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
