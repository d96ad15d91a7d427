"""Per-tag transduction (T1-T18): text fragments with run boundaries, gathered into runs."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import escape_html, run_string
from .implicit import LEFT, TAGS, labels, owner
from .merge import KEY
from .numbers import whole

NO_STYLE = "cast(array() as array<string>)"
#: The marks of form check boxes.
OPEN_BOX, CROSSED_BOX, NO_BOX = "☐", "☒", "----checkbox failed----"


@dataclass
class Handler:
    """What a tag of the user's adds: text, an expression over name, attrs and text of its node (null: nothing), as a run of its own or within the run that is open.

    With into off nothing below such a node is read.  Tags of the library's own cannot be overridden.
    """

    text: Callable[[], Column]
    alone: bool = True
    into: bool = True


def pruned(nodes: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """nodes without those below a node whose handler reads nothing there: such nodes are open while a later pre is below their post."""
    if not (closed := [tag for tag, h in handlers.items() if not h.into]):
        return nodes
    before = Window.partitionBy(*KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.when(F.col("name").isin(*closed), F.col("post"))).over(before)
    return nodes.withColumn("_end", F.coalesce(end, F.lit(-1))).filter("pre > _end").drop("_end")


def form_values(nodes: DataFrame) -> DataFrame:
    """doc_id, path, pre, value of every w:checkBox and w:ddList, from its children."""
    kids = nodes.filter("up in ('w:checkBox', 'w:ddList')")
    val = F.col("attrs")["w:val"]
    first = lambda name, v: F.min_by(F.when(F.col("name") == name, F.struct(v.alias("v"))), F.when(F.col("name") == name, F.col("pre")))["v"]
    got = kids.groupBy(*KEY, F.col("parent").alias("pre"), F.col("up").alias("kind")).agg(
        first("w:checked", F.coalesce(F.nullif(val, F.lit("")), F.lit("1"))).alias("checked"),
        first("w:default", val).alias("default"),
        F.greatest(F.coalesce(whole(first("w:result", val)), F.lit(0)), F.lit(0)).alias("result"),
        F.array_sort(F.collect_list(F.when(F.col("name") == "w:listEntry", F.struct("pre", val.alias("v"))))).alias("entries"),
    )
    box = F.coalesce("checked", "default")
    mark = F.when(box.isin("0", "false"), OPEN_BOX).when(box.isin("1", "true"), CROSSED_BOX).otherwise(NO_BOX)
    return got.select(*KEY, "pre", F.when(F.col("kind") == "w:checkBox", mark).otherwise(F.get("entries", F.col("result"))["v"]).alias("value"))


def math_text(nodes: DataFrame) -> DataFrame:
    """T4: doc_id, path, pre, value: all text below each m:oMath that stands in no other."""
    found = nodes.filter("formula is not null").select(*KEY, F.col("pre").alias("at"), "formula", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return found.groupBy(*KEY, F.col("formula").alias("pre")).agg(F.concat(F.lit("<latex>"), text, F.lit("</latex>")).alias("value"))


#: Tags whose text lies elsewhere: behind a relationship, or below them.
PICTURES, FORMS, FORMULA = ("a:blip", "v:imagedata"), ("w:checkBox", "w:ddList"), "m:oMath"
#: Tags whose text is made from their attributes.
NAMED = ("w:sym", "w:footnoteReference", "w:endnoteReference", "wp:docPr")


def fragments(
    nodes: DataFrame, runs: DataFrame | None, rels: DataFrame | None, style: Column | None, html: bool, handlers: dict[str, Handler] | None = None, tags: set[str] | None = None,
    keyed: bool = False,
) -> DataFrame:
    """doc_id, path, in_link, owner, seq, sub, brk, text, html_style: what each node adds to its paragraph, or to its child of a hyperlink.

    brk counts the runs begun by the row.  A row that stands on its own (T18) is followed by one (sub 1) that reopens the style it broke into.
    runs: see merge.merge_runs; None where no hyperlinks merge (with html on: where there are none), then neighbours are known from the nodes' own facts.
    keyed: only rows with text, with `run`, which tells the rows of one run from those beside it, in place of brk; for nodes of which `simple` holds, without handlers and hyperlinks.
    style: the HTML style of a w:r, an expression over props, null with html off.  tags: those that nodes have, of PICTURES, FORMS, FORMULA and NAMED (None: all); without such tags and handlers no attributes are read.
    """
    handlers = handlers or {}
    if known := sorted(set(handlers) & {*TAGS, "w:p", "w:hyperlink"}):
        raise ValueError(f"tags with a handler of their own: {known}")
    attr = lambda a: F.col("attrs")[a]
    name, none, empty = F.col("name"), F.expr(NO_STYLE), F.lit("")
    facts = ["par", "run", "link", "link_child", "chain", "chain_end", "child_chain", "props"]
    bare = not handlers and tags is not None and not tags & {*PICTURES, *FORMS, FORMULA, *NAMED}
    nodes = nodes.withColumn("attrs", F.expr("cast(null as map<string,string>)")) if bare else nodes
    live = pruned(nodes, handlers).filter("not math").filter(name.isin(*TAGS, *handlers)).select(*KEY, "pre", "post", "name", "attrs", "text", *facts, owner().alias("_par"))
    elsewhere = [x for x in (*PICTURES, *FORMS, FORMULA) if tags is None or x in tags]
    plain = live.filter(~name.isin(*elsewhere)) if elsewhere else live
    plain = plain.withColumn("target", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("string"))
    if elsewhere:
        rid = F.when(name == "a:blip", attr("r:embed")).when(name == "v:imagedata", attr("r:id"))
        odd = live.filter(name.isin(*elsewhere)).withColumn("rel_id", rid)
        odd = odd.join(rels.hint("merge"), [*KEY, "rel_id"], "left").drop("rel_id") if set(elsewhere) & set(PICTURES) else odd.withColumn("target", F.lit(None).cast("string")).drop("rel_id")
        values = [f for f, found in ((form_values, set(elsewhere) & set(FORMS)), (math_text, FORMULA in elsewhere)) if found]
        if values:
            odd = odd.join(functools.reduce(DataFrame.unionByName, [f(nodes) for f in values]).hint("merge"), [*KEY, "pre"], "left")
        else:
            odd = odd.withColumn("value", F.lit(None).cast("string"))
        live = plain.unionByName(odd)
    else:
        live = plain
    symbol = F.concat(F.lit("<span style=font-family:"), F.coalesce(attr("w:font"), F.lit("None")), F.lit(">&#x0"), F.substring(F.coalesce(attr("w:char"), F.lit("None")), 2, 99), F.lit(";</span>"))
    inline = F.when(name.isin("w:t", "m:t"), escape_html(F.col("text")) if html else F.col("text")).when(name == "w:br", "\n").when(name == "w:sym", symbol)
    alone = (
        F.when(name == "w:tab", "\t")
        .when(name == "w:footnoteReference", F.concat(F.lit("----footnote"), attr("w:id"), F.lit("----")))
        .when(name == "w:endnoteReference", F.concat(F.lit("----endnote"), attr("w:id"), F.lit("----")))
        .when(name.isin(*PICTURES), F.concat(F.lit("----"), F.col("target"), F.lit("----")))
        .when(name == "wp:docPr", F.concat(F.lit("----Image alt text---->"), attr("descr"), F.lit("<")))
        .when(name.isin(*FORMS, FORMULA), F.col("value"))
    )
    for tag, h in handlers.items():
        inline, alone = (inline, alone.when(name == tag, h.text())) if h.alone else (inline.when(name == tag, h.text()), alone)
    in_link = F.col("link").isNotNull()
    own_style = none if style is None else F.when(name == "w:r", style)
    live = live.select(*KEY, "pre", "post", (name == "w:r").alias("is_run"), inline.alias("inline"), alone.alias("alone"), in_link.alias("in_link"), *facts[:-1], "_par", own_style.alias("style"))
    live = live.filter("is_run or inline is not null or alone is not null")
    row = lambda seq, sub, brk, text, style: F.struct(seq.alias("seq"), F.lit(sub).alias("sub"), F.lit(brk).alias("brk"), text.alias("text"), style.alias("html_style"))
    child, closed = F.col("child_chain"), F.when(F.col("pre") == F.col("chain"), F.array(row(F.col("chain_end"), 0, 1, empty, none)))
    if runs is not None:
        live = live.join(runs.select(*KEY, "run", "canon_run", "last_post").hint("merge"), [*KEY, "run"], "left")
        live = live.join(runs.select(*KEY, F.col("run").alias("link_child"), F.col("canon_run").alias("_child")).hint("merge"), [*KEY, "link_child"], "left")
        if style is not None:
            styles = nodes.filter("name = 'w:r' and props is not null").select(*KEY, F.col("pre").alias("canon_run"), style.alias("_style"))
            live = live.drop("style").join(styles.hint("merge"), [*KEY, "canon_run"], "left").withColumn("style", F.coalesce("_style", none))
        child, closed = F.coalesce("_child", "link_child"), F.when(F.col("is_run") & (F.col("pre") == F.col("canon_run")), F.array(row(F.col("last_post"), 0, 1, empty, none)))
    elif style is None:
        live = live.withColumn("canon_run", F.col("chain"))
    else:  # runs of one chain, with what stands in them, meet in one window; a run of another style closes the one before
        w = Window.partitionBy(*KEY, "chain").orderBy("pre")
        mine = F.when(F.col("is_run"), F.struct("style", "post"))
        live = live.withColumn("_last", F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        live = live.withColumn("_new", F.col("is_run") & (F.col("_last").isNull() | (F.col("_last.style") != F.col("style"))))
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        live = live.withColumn("canon_run", F.when(F.col("chain").isNotNull(), F.last(F.when(F.col("_new"), F.col("pre")), ignorenulls=True).over(so_far)))
        live = live.withColumn("style", F.coalesce(F.when(F.col("chain").isNotNull(), F.last(F.when(F.col("is_run"), F.col("style")), ignorenulls=True).over(so_far)), none))
        before = F.when(F.col("_new") & F.col("_last").isNotNull(), F.array(row(F.col("_last.post"), 0, 1, empty, none)))
        closed = F.when(closed.isNotNull() & before.isNotNull(), F.concat(closed, before)).otherwise(F.coalesce(closed, before))
    if keyed:
        text = F.when(F.col("inline").isNotNull(), F.struct("inline", F.col("canon_run").alias("run"), (F.col("style") if style is not None else none).alias("style")))
        text = F.coalesce(text, F.when(F.col("alone").isNotNull(), F.struct(F.col("alone").alias("inline"), F.col("pre").alias("run"), none.alias("style"))))
        live = live.withColumn("_row", text).filter("_row is not null")
        return live.select(*KEY, "in_link", F.col("_par").alias("owner"), F.col("pre").alias("seq"), F.lit(0).alias("sub"), F.col("_row.run").alias("run"), F.col("_row.inline").alias("text"), F.col("_row.style").alias("html_style"))
    # a run around a text box is not open inside the box
    is_open = F.col("canon_run").isNotNull() & (F.col("in_link") | F.col("par").isNull() | (F.col("run") > F.col("par")))
    live = live.withColumn("owner", F.when(F.col("in_link"), child).otherwise(F.col("_par"))).withColumn("_open", F.when(is_open, F.col("style")).otherwise(none))
    opens = F.when(F.col("is_run") & (F.col("pre") == F.col("canon_run")), F.concat(F.array(row(F.col("pre"), 0, 1, empty, F.col("_open"))), closed))
    text = F.when(F.col("inline").isNotNull(), F.array(row(F.col("pre"), 0, 0, F.col("inline"), none)))
    own = F.when(F.col("alone").isNotNull(), F.array(row(F.col("pre"), 0, 1, F.col("alone"), none), row(F.col("pre"), 1, 1, empty, F.col("_open"))))
    return live.withColumn("rows", F.coalesce(opens, text, own)).filter("rows is not null").select(*KEY, "in_link", "owner", F.inline("rows"))


def simple() -> Column:
    """Whether runs can be told by their numbers alone: each stands straight in a paragraph, or in a tag straight in one, and no text stands outside; an aggregate over nodes without hyperlinks."""
    text = F.col("name").isin(*[t for t in TAGS if t != "w:r"]) & ~F.col("math")
    loose = text & (F.col("chain").isNull() | F.col("par").isNull() | (F.col("run") < F.col("par")))
    above = (F.col("up") == "w:p") | ((F.col("upup") == "w:p") & F.col("up").isin("w:ins", "w:smartTag", "w:sdtContent"))
    odd = loose | ((F.col("name") == "w:r") & (F.col("par").isNull() | ~F.coalesce(above, F.lit(False))))
    return ~F.coalesce(F.bool_or(odd), F.lit(False))


def gather(rows: DataFrame) -> DataFrame:
    """doc_id, path, owner, runs: the runs of each owner with text, in order: array of (html_style, text, seq of their first text).

    One aggregate, which begins before the exchange: what is exchanged is a row for each owner.  The rows at which runs begin cut its list: by brk, or where `run` changes (see fragments).
    """
    keyed = "run" in rows.columns
    items = rows.groupBy(*KEY, "owner").agg(F.sort_array(F.collect_list(F.struct("seq", "sub", "run" if keyed else "brk", "text", "html_style"))).alias("items"))
    first = lambda x, n: (n == 0) | ((x["run"] != F.get("items", n - 1)["run"]) if keyed else (x["brk"] == 1))
    begun = F.filter(F.transform("items", lambda x, n: F.when(first(x, n), n)), lambda n: n.isNotNull())
    items = items.withColumn("begun", begun)
    pieces = F.transform("begun", lambda a, n: F.slice("items", a + 1, F.coalesce(F.get("begun", n + 1), F.size("items")) - a))
    style = lambda piece: piece[0]["html_style"] if keyed else F.when(piece[0]["brk"] == 1, piece[0]["html_style"]).otherwise(F.expr(NO_STYLE))
    filled = lambda piece: F.filter(piece, lambda x: x["text"] != "")
    runs = F.transform(pieces, lambda x: F.struct(style(x).alias("html_style"), F.array_join(F.transform(x, lambda y: y["text"]), "").alias("text"), F.get(filled(x), F.lit(0))["seq"].alias("seq")))
    return items.select(*KEY, "owner", F.filter(runs, lambda x: x["text"] != "").alias("runs"))


def link_rows(nodes: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """The fragments of hyperlinks: each child is a paragraph of its own, joined by blank lines, in an <a> if the rId resolves."""
    inner = gather(rows.filter("in_link")).select(*KEY, "owner", F.array_join(F.transform("runs", run_string), "").alias("text"))
    child = nodes.filter("pre = link_child").select(*KEY, F.col("pre").alias("owner"), "link")
    pieces = inner.join(child.hint("merge"), [*KEY, "owner"]).join(links.hint("merge"), [*KEY, "link"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("owner", "text"))), lambda x: x["text"]), "\n\n")
    whole = pieces.groupBy(*KEY, F.col("canon_link").alias("link")).agg(text.alias("text"))
    every = links.filter("link = canon_link").select(*KEY, "link", "target", "anchor").join(whole.hint("merge"), [*KEY, "link"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    href = F.concat(F.col("target"), F.when((F.col("anchor") != "") & (F.col("target") != ""), F.concat(F.lit("#"), F.col("anchor"))).otherwise(""))
    every = every.withColumn("text", F.when(F.col("target").isNotNull(), F.concat(F.lit('<a href="'), href, F.lit('">'), F.col("text"), F.lit("</a>"))).otherwise(F.col("text")))
    at = nodes.filter("name = 'w:hyperlink' and link is null").select(*KEY, F.col("pre").alias("link"), owner().alias("owner"))
    found = every.join(at.hint("merge"), [*KEY, "link"])
    two = F.array(F.struct(F.col("link").alias("seq"), F.lit(0).alias("sub"), F.lit(1).alias("brk"), F.col("text"), F.expr(NO_STYLE).alias("html_style")), F.struct(F.col("link").alias("seq"), F.lit(1).alias("sub"), F.lit(1).alias("brk"), F.lit("").alias("text"), F.expr(NO_STYLE).alias("html_style")))
    return found.select(*KEY, F.lit(False).alias("in_link"), "owner", F.inline(two))


def opening_rows(pars: DataFrame, nodes: DataFrame, noted: bool = True) -> DataFrame:
    """What stands before a paragraph's own text: labels of notes that wait for the next paragraph, then its bullet.

    pars: doc_id, path, pre, open_seq, bullet.  Labels after the last paragraph stand in one of their own.  noted: whether there are notes.
    """
    row = lambda df, sub, text: df.select(*KEY, F.lit(False).alias("in_link"), "owner", F.col("owner").alias("seq"), sub.alias("sub"), F.lit(1).alias("brk"), text.alias("text"), F.expr(NO_STYLE).alias("html_style"))
    own = pars.withColumn("owner", F.col("pre"))
    # two rows: what follows a bullet is another run
    bullets = own.filter("bullet <> ''").withColumn("_two", F.explode(F.array(F.lit(-2), F.lit(-1))))
    bullets = row(bullets, F.col("_two"), F.when(F.col("_two") == -2, F.col("bullet")).otherwise(F.lit("")))
    if not noted:
        return bullets
    notes = labels(nodes).select(*KEY, F.col("pre").alias("at"), "label")
    w = Window.partitionBy(*KEY).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    both = notes.unionByName(pars.select(*KEY, F.col("open_seq").alias("at"), F.col("pre").alias("par")), allowMissingColumns=True)
    waiting = both.withColumn("owner", F.coalesce(F.last("par", ignorenulls=True).over(w), F.lit(LEFT))).filter("label is not null")
    first = row(waiting, F.col("at") - 2**30, F.col("label"))  # before the bullet, in their own order
    last = row(waiting.select(*KEY, "owner").distinct(), F.lit(-1), F.lit(""))
    return first.unionByName(bullets).unionByName(last)
