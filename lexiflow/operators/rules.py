"""Rewrite rules: menus and edits, the graph that they make, and their simulation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.words import edit, tier_rank

#: Rules of one experiment at most.
MOST_RULES = 30


def menu(words: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(code, src, dst) for rules (code, kind, old, new): every word that a rule applies to, with its output.

    Rules are few and become one array of candidates per word; no join is needed.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"use at most {MOST_RULES} rules")
    made = F.array(*[F.struct(F.lit(code).alias("code"), edit(F.col("word"), kind, old, new).alias("dst")) for code, kind, old, new in rules])
    rows = words.select(F.col("word").alias("src"), F.explode(made).alias("m")).select("m.code", "src", "m.dst")
    return rows.filter("dst is not null and dst <> src and dst <> ''")


def attested(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs whose output is a word of ``words`` (word); the rest is a left_anti of the same join."""
    return pairs.join(words.select(F.col("word").alias("dst")), "dst", "left_semi")


def edges(pairs: DataFrame) -> DataFrame:
    """One edge (src, dst, codes) per pair of words, with all rules that make it."""
    return pairs.groupBy("src", "dst").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def live_routes(routes: DataFrame, active: list[str], codes: str = "codes") -> DataFrame:
    """Routes of which every part (``A+B``, ``C1.2`` counts as C1) is an active rule."""
    part = lambda c: F.split(F.regexp_replace(c, r"\.\d+$", ""), r"\+")
    parts = F.flatten(F.transform(codes, part))
    return routes.filter(F.forall(parts, lambda p: F.regexp_replace(p, r"\.\d+$", "").isin(*active)))


def weakest(confidences: Column) -> Column:
    """Rank of the weakest confidence of an array."""
    return F.array_max(F.transform(confidences, tier_rank))


def simulate(counts: DataFrame, rules: list[tuple[str, str, str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """(after, routes) of moving each word's mass n along rules (code, kind, old, new, fraction).

    A rule moves its fraction of a word to its output; fractions of the rules
    that apply may not exceed 1 in sum, and outputs may not be empty, begin
    with q or hold a space: the query fails where they do.
    """
    parts = F.filter(
        F.array(*[F.struct(F.lit(c).alias("code"), edit(F.col("word"), k, a, b).alias("dst"), F.lit(float(f)).alias("w")) for c, k, a, b, f in rules]),
        lambda m: m["dst"].isNotNull() & (m["dst"] != F.col("word")) & (m["w"] > 0),
    )
    rows = counts.select("word", "n", parts.alias("parts"))
    used = F.aggregate("parts", F.lit(0.0), lambda s, m: s + m["w"])
    bad = F.exists("parts", lambda m: m["dst"].rlike(r"^$|^q|\s"))
    used = F.when(used > 1 + 1e-10, F.raise_error(F.concat(F.lit("rules allocate over 100% of "), "word")).cast("double")).when(bad, F.raise_error(F.concat(F.lit("bad output for "), "word")).cast("double")).otherwise(used)
    rows = rows.withColumn("used", used)
    routes = rows.select("word", "n", F.explode("parts").alias("m")).select("word", F.col("m.dst").alias("dst"), "m.code", (F.col("n") * F.col("m.w")).alias("mass"))
    stay = rows.select("word", (F.col("n") * F.greatest(F.lit(0.0), 1 - F.col("used"))).alias("mass"))
    after = stay.unionByName(routes.select(F.col("dst").alias("word"), "mass")).groupBy("word").agg(F.sum("mass").alias("mass"))
    return after, routes.groupBy("word", "dst").agg(F.sum("mass").alias("mass"))


class ContextRule(NamedTuple):
    """A rule of an experiment: an edit (exact, prefix, suffix, contains) or a ``known`` menu, where ``where`` holds of a word's context."""

    code: str
    kind: str
    fraction: float
    old: str = ""
    new: str = ""
    where: Column | None = None


def simulate_in_context(cells: DataFrame, rules: list[ContextRule], menu: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(after (word, mass), routes (word, dst, code, mass)) of rules that look at a word's context.

    ``cells`` has a row per different word and context, with its number n and
    whatever columns the rules' conditions name; tokens are counted before any
    rule is tried. ``menu`` (code, word, outs) lists the outputs of known rules.
    A rule's fraction is its whole budget, shared equally by its different
    outputs; a rule whose only output is the word itself does nothing. The
    query fails where fractions exceed 1 in sum or an output is empty, begins
    with q or holds a space.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"use at most {MOST_RULES} rules")
    rows = cells
    known = [r.code for r in rules if r.kind == "known"]
    if known:
        per = menu.filter(F.col("code").isin(*known)).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("code", "outs"))).alias("menus"))
        rows = rows.join(per, "word", "left")

    def outs(r):
        made = F.try_element_at("menus", F.lit(r.code)) if r.kind == "known" else F.when(edit(F.col("word"), r.kind, r.old, r.new).isNotNull(), F.array(edit(F.col("word"), r.kind, r.old, r.new)))
        made = F.array_distinct(made)
        return made if r.where is None else F.when(r.where, made)

    parts = F.filter(
        F.array(*[F.struct(F.lit(r.code).alias("code"), outs(r).alias("outs"), F.lit(float(r.fraction)).alias("w")) for r in rules]),
        lambda p: F.coalesce((F.size(p["outs"]) > 0) & (p["w"] > 0) & ~((F.size(p["outs"]) == 1) & F.array_contains(p["outs"], F.col("word"))), F.lit(False)),
    )
    rows = rows.select("word", "n", parts.alias("parts"))
    used = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"])
    bad = F.exists("parts", lambda p: F.exists(p["outs"], lambda o: o.rlike(r"^$|^q|\s")))
    used = F.when(used > 1 + 1e-10, F.raise_error(F.concat(F.lit("rules allocate over 100% of "), "word")).cast("double")).when(bad, F.raise_error(F.concat(F.lit("bad output for "), "word")).cast("double")).otherwise(used)
    rows = rows.withColumn("used", used)
    each = rows.select("word", "n", F.explode("parts").alias("p")).select("word", "p.code", F.explode("p.outs").alias("dst"), (F.col("n") * F.col("p.w") / F.size("p.outs")).alias("mass"))
    routes = each.groupBy("word", "dst", "code").agg(F.sum("mass").alias("mass"))
    stay = rows.groupBy("word").agg(F.sum(F.col("n") * F.greatest(F.lit(0.0), 1 - F.col("used"))).alias("mass"))
    after = stay.unionByName(routes.select(F.col("dst").alias("word"), "mass")).groupBy("word").agg(F.sum("mass").alias("mass"))
    return after, routes
