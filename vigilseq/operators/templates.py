"""Templates learned from raw lines.

Lines are cut at blanks.  Lines with equally many tokens and the same leading tokens are a
leaf of a tree; a leading token with a digit counts as variable.  Where a place of a leaf
has more than ``max_values`` different tokens, only tokens in at least ``share`` of the
leaf's lines stay, and the others become ``<*>``.  Then templates that differ in one place
are merged when there are at least ``variants`` of them, the place with most variants
first, until nothing changes.

All steps are grouped counts over distinct lines, so the order of lines does not matter:
the same lines give the same templates, and an id is the hash of its template.  Per place
of a leaf the tokens in most lines are kept, as many as can stay at all; the limit is
applied before the shuffle.  Lines are matched through the places that templates leave
open: a line takes the text it has with those places masked, and texts are joined.

Lines without tokens have no template.  Equal lines count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.functions.text import event_id, mask_template
from vigilseq.sources.staging import stage

ANY = "<*>"
BROADCAST_ROWS = 200_000  # rows of a tree or of templates that are sent to every executor


def plain_text(line: Column, rules: Sequence[str] = ()) -> Column:
    """The line after masking by ``rules``, with single blanks between its tokens; null without tokens."""
    text = mask_template(line, list(rules))
    return F.nullif(F.btrim(F.regexp_replace(text, "[ \t]+", " ")), F.lit(""))


def _tokens(text: str = "text") -> Column:
    return F.split(text, " ")


def _lead(leading: int) -> Column:
    """Leading tokens of a line; those with a digit are variable."""
    first = F.slice(_tokens(), 1, leading)
    return F.array_join(F.transform(first, lambda t: F.when(t.rlike("[0-9]"), ANY).otherwise(t)), " ")


def _counted(lines: DataFrame, column: str, rules: Sequence[str]) -> DataFrame:
    """(text, cnt) of the distinct lines."""
    texts = lines.select(plain_text(F.col(column), rules).alias("text")).filter("text is not null")
    return texts.groupBy("text").agg(F.count(F.lit(1)).alias("cnt"))


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def grow_tree(texts: DataFrame, leading: int, max_values: int, share: float) -> DataFrame:
    """(n_tokens, lead, kept) per leaf: the tokens that stay, place by place, from written (text, cnt)."""
    leaf = ["n_tokens", "lead"]
    rows = texts.select(F.size(_tokens()).alias("n_tokens"), _lead(leading).alias("lead"), "cnt", F.posexplode(_tokens()).alias("place", "token"))
    counts = rows.groupBy(*leaf, "place", "token").agg(F.sum("cnt").alias("cnt"))
    # No more tokens than these can stay in a place.
    most = max(max_values + 1, math.floor(1 / share))
    likeliest = Window.partitionBy(*leaf, "place").orderBy(F.desc("cnt"), "token")
    top = counts.withColumn("rank", F.row_number().over(likeliest)).filter(F.col("rank") <= most)
    places = top.groupBy(*leaf, "place").agg(F.collect_list(F.struct("token", "cnt")).alias("tokens"))
    totals = texts.groupBy(F.size(_tokens()).alias("n_tokens"), _lead(leading).alias("lead")).agg(F.sum("cnt").alias("total"))
    few = F.size("tokens") <= max_values
    stay = F.filter("tokens", lambda t: few | (t["cnt"] >= F.col("total") * share))
    kept = places.join(totals, leaf).select(*leaf, "place", F.transform(stay, lambda t: t["token"]).alias("kept"))
    order = F.sort_array(F.collect_list(F.struct("place", "kept")))  # one entry per token of a line
    return kept.groupBy(*leaf).agg(order["kept"].alias("kept"))


def _generalise(templates: DataFrame, variants: int) -> DataFrame | None:
    """Templates after one round of merging; None where nothing merges.  ``templates`` is written (template, cnt)."""
    tokens = F.split("template", " ")
    open_place = F.concat(F.slice(tokens, F.lit(1), F.col("place")), F.array(F.lit(ANY)), F.slice("tokens", F.col("place") + 2, F.size("tokens")))
    each = templates.select("template", tokens.alias("tokens"), F.posexplode(tokens).alias("place", "token")).filter(F.col("token") != ANY)
    each = each.select("template", "place", F.array_join(open_place, " ").alias("wider"))
    groups = each.groupBy("wider", "place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= variants)
    best = F.max_by("wider", F.struct("n", -F.col("place")))
    chosen = stage(each.join(groups, ["wider", "place"]).groupBy("template").agg(best.alias("wider")), "wider")
    if not chosen.count():
        return None
    merged = templates.join(chosen, "template", "left")
    return merged.groupBy(F.coalesce("wider", "template").alias("template")).agg(F.sum("cnt").alias("cnt"))


def _described(templates: DataFrame) -> DataFrame:
    tokens = F.split("template", " ")
    return templates.select(
        event_id(F.col("template")).alias("event"),
        "template",
        "cnt",
        F.size(tokens).alias("n_tokens"),
        F.size(F.filter(tokens, lambda t: t == ANY)).alias("n_open"),
    )


def mine_templates(
    lines: DataFrame,
    column: str = "line",
    rules: Sequence[str] = (),
    leading: int = 1,
    max_values: int = 20,
    share: float = 0.02,
    variants: int = 4,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(event, template, cnt, n_tokens, n_open) learned from raw lines; ``cnt`` is their number of lines."""
    texts = stage(_counted(lines, column, rules), "texts")
    tree = stage(grow_tree(texts, leading, max_values, share), "tree")
    leaves = texts.withColumns({"n_tokens": F.size(_tokens()), "lead": _lead(leading)}).join(_small(tree, broadcast_rows), ["n_tokens", "lead"])
    token = F.transform(_tokens(), lambda t, i: F.when(F.array_contains(F.get("kept", i), t), t).otherwise(ANY))
    found = leaves.groupBy(F.array_join(token, " ").alias("template")).agg(F.sum("cnt").alias("cnt"))
    templates = stage(found, "templates")
    while (wider := _generalise(templates, variants)) is not None:
        templates = stage(wider, "templates")
    return _described(templates)


def match_templates(
    lines: DataFrame,
    templates: DataFrame,
    column: str = "line",
    rules: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``lines`` with ``template``, ``event`` and ``known``.

    Of several templates a line takes the one with the fewest open places, then the first
    by text.  A line that fits none is its own template and not ``known``.
    """
    known = stage(templates.select("template").distinct(), "known")
    tokens = F.split("template", " ")
    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i) == ANY)
    masks = stage(known.select(F.size(tokens).alias("n_tokens"), places.alias("open")).distinct(), "masks")
    texts = stage(lines.select(plain_text(F.col(column), rules).alias("text")).filter("text is not null").distinct(), "texts")
    masked = F.transform(_tokens(), lambda t, i: F.when(F.array_contains("open", i), ANY).otherwise(t))
    tried = texts.withColumn("n_tokens", F.size(_tokens())).join(_small(masks, broadcast_rows), "n_tokens")
    tried = tried.select("text", F.size("open").alias("n_open"), F.array_join(masked, " ").alias("template"))
    hits = tried.join(_small(known, broadcast_rows), "template")
    best = stage(hits.groupBy("text").agg(F.min_by("template", F.struct("n_open", "template")).alias("_template")), "matches")
    rows = lines.withColumn("_text", plain_text(F.col(column), rules))
    out = rows.join(_small(best, broadcast_rows), rows["_text"] == best["text"], "left")
    template = F.coalesce("_template", "_text")
    return out.select(
        *[lines[f"`{c}`"] for c in lines.columns],
        template.alias("template"),
        event_id(template).alias("event"),
        F.col("_template").isNotNull().alias("known"),
    )


def extend_templates(templates: DataFrame, lines: DataFrame, column: str = "line", rules: Sequence[str] = (), **mining) -> DataFrame:
    """Templates after more lines: known ones keep their ids and gain lines, lines that fit none are mined."""
    matched = stage(match_templates(lines.select(column), templates, column, rules), "matched")
    gained = matched.filter("known").groupBy("template").agg(F.count(F.lit(1)).alias("cnt"))
    new = mine_templates(matched.filter(~F.col("known")), column, rules, **mining)
    every = templates.select("template", "cnt").unionByName(gained).unionByName(new.select("template", "cnt"))
    return _described(every.groupBy("template").agg(F.sum("cnt").alias("cnt")))
