"""Copy events on a page: donors of the opposite variant, later exact words, links of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.ranks import numbered


def reconcile(events: DataFrame, toks: DataFrame) -> DataFrame:
    """Events (id, page, locus, idx, word) with ``reason``: null where the text holds that word at that place."""
    rest = [c for c in events.columns if c not in ("page", "locus", "idx")]
    place = ["page", "locus", "idx"]
    word, none = F.col("word"), F.lit(None)
    # both meet in one shuffle by line; a place's words are gathered where the line already lies
    rows = events.select(*place, F.struct(*rest).alias("event"), none.cast("string").alias("found"))
    kind = rows.schema["event"].dataType
    rows = rows.unionByName(toks.select(*place, none.cast(kind).alias("event"), word.alias("found"))).repartition("page", "locus")
    each = rows.withColumn("last", F.max(F.when(F.col("event").isNull(), F.col("idx"))).over(Window.partitionBy("page", "locus")))
    each = each.withColumn("words", F.collect_list("found").over(Window.partitionBy(*place))).filter("event is not null")
    known = F.col("page").isNotNull() & F.col("locus").isNotNull()
    each = each.select(*place, "event.*", F.when(known, F.col("last")).alias("last"), F.explode_outer(F.when(known & F.col("idx").isNotNull(), F.col("words"))).alias("found"))
    reason = F.when(F.col("last").isNull(), "line is absent").when((F.col("idx") < 0) | (F.col("idx") > F.col("last")), "position outside the line").when(~F.col("found").eqNullSafe(word), "word differs")
    return each.withColumn("reason", reason).select(*events.columns, "reason")


def donor_flags(events: DataFrame) -> DataFrame:
    """Events (page, family, word, new, line, idx) with the number of donors in each scope and of later exact words.

    A donor is the opposite variant of the family on an earlier line of the
    page. Counts per line are enough: they are window sums over lines, so no
    pair is made.
    """
    per = events.groupBy("page", "family", "new", "line").agg(F.count("*").alias("c"))
    opposite = per.select("page", "family", (~F.col("new")).alias("new"), "line", F.col("c").alias("d"))
    both = events.select("page", "family", "new", "line").distinct().withColumn("d", F.lit(0)).unionByName(opposite).groupBy("page", "family", "new", "line").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("page", "family", "new").orderBy("line")
    before = lambda n: F.coalesce(F.sum("d").over(w.rangeBetween(-n, -1)), F.lit(0))
    low = F.coalesce(F.sum(F.when(F.col("line") < 2, F.col("d"))).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flags = both.select("page", "family", "new", "line", F.coalesce(F.sum("d").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("page_donors"), before(3).alias("local3"), before(10).alias("local10"), before(1).alias("last"), low.alias("low"))
    flags = flags.withColumn("usual", F.when(F.col("line") >= 3, F.col("page_donors") - F.col("low")).otherwise(F.col("last"))).drop("last", "low")
    order = Window.partitionBy("page", "family", "word").orderBy("line", "idx")
    every = Window.partitionBy("page", "family", "word")
    rows = events.withColumn("later", F.count("*").over(every) - F.row_number().over(order)).withColumn("first_exact", F.row_number().over(order) == 1)
    variant = Window.partitionBy("page", "family", "new").orderBy("line", "idx")
    rows = rows.withColumn("first_variant", F.row_number().over(variant) == 1)
    return rows.join(flags, ["page", "family", "new", "line"])


def donor_pairs(events: DataFrame, most: int = 10) -> DataFrame:
    """(page, family, target, donor, distance) within ``most`` lines, for drawing links; ids are (line, idx)."""
    t = events.select("page", "family", "new", F.col("line").alias("tl"), F.col("idx").alias("ti"))
    s = events.select("page", "family", (~F.col("new")).alias("new"), F.col("line").alias("dl"), F.col("idx").alias("di"))
    rows = t.join(s, ["page", "family", "new"]).filter((F.col("dl") < F.col("tl")) & (F.col("tl") - F.col("dl") <= most))
    return rows.select("page", "family", "tl", "ti", "dl", "di", (F.col("tl") - F.col("dl")).alias("distance"))


def copy_stats(flags: DataFrame, *by: str) -> DataFrame:
    return flags.groupBy(*by).agg(
        F.count("*").alias("targets"),
        F.count_if("new").alias("new_targets"),
        *[F.count_if(F.col(c) > 0).alias(f"with_{c}") for c in ("page_donors", "local3", "local10", "usual")],
        F.sum("page_donors").alias("candidate_pairs"),
        F.sum("later").alias("later_pairs"),
        F.count_if(F.col("later") > 0).alias("with_later"),
    )


def persistence(events: DataFrame, horizon: int = 3) -> DataFrame:
    """(page, family, again): new forms on the ``horizon`` lines after a family's first one on a page."""
    w = Window.partitionBy("page", "family")
    news = events.filter("new").withColumn("start", F.min("line").over(w))
    return news.groupBy("page", "family").agg(F.count_if((F.col("line") > F.col("start")) & (F.col("line") <= F.col("start") + horizon)).alias("again"))


def shuffled_lines(events: DataFrame, runs: int) -> DataFrame:
    """Events once for each run 0 to ``runs``, with ``run``; run 0 is as given.

    In the others the lines of a page change places: the numbers of its lines
    that hold events are dealt out anew, in the order of a digest of run, page
    and line. Only the lines of one page meet: events are shuffled once, by
    page, and the runs are made where they then are, without a join.
    """
    rest = [c for c in events.columns if c not in ("page", "line")]
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: few bytes here are many rows after
    held = events.filter("page is not null and line is not null").repartition(tasks, "page").groupBy("page", "line").agg(F.collect_list(F.struct(*rest)).alias("held"))
    pages = held.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line", "held"))).alias("lines")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs))))
    digest = lambda line: F.when(F.col("run") > 0, F.md5(F.concat_ws(":", "run", "page", line))).otherwise("")
    mixed = F.array_sort(F.transform("lines", lambda x: F.struct(digest(x["line"]).alias("mixed"), x["line"].alias("line"), x["held"].alias("held"))))
    own = F.col("lines.line")
    dealt = pages.select("run", "page", F.explode(F.transform(mixed, lambda x, i: F.struct(F.get(own, i).alias("line"), x["held"].alias("held")))).alias("m"))
    return dealt.select("run", "page", "m.line", F.explode("m.held").alias("e")).select("page", "line", "e.*", "run").select(*events.columns, "run")


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, observed, mean, low, high, p) of rows (by, run, value): run 0 against the others.

    low and high hold the middle 95 % of the runs (nearest ranks); p is the share
    of runs, the observed one among them, that are as large or larger. A row of
    the groups holds one number a run, whatever the size of the data.
    """
    drawn, own = F.array_sort(F.collect_list(F.when(F.col("run") > 0, F.col(value)))), F.max(F.when(F.col("run") == 0, F.col(value)))
    each = rows.groupBy(*by).agg(own.alias("observed"), F.avg(F.when(F.col("run") > 0, F.col(value))).alias("mean"), drawn.alias("_drawn"))
    n = F.size("_drawn")
    at = lambda q: F.get("_drawn", F.floor(q * (n - 1) + 0.5).cast("int"))
    more = F.size(F.filter("_drawn", lambda v: v >= F.col("observed")))
    return each.select(*by, "observed", "mean", at(0.025).alias("low"), at(0.975).alias("high"), ((more + 1) / (n + 1)).alias("p"))


def order_control(events: DataFrame, runs: int, *by: str) -> DataFrame:
    """(by, scope, targets, observed, mean, low, high, p): targets with an earlier donor, in the given and in shuffled line orders.

    All runs are one job: a page of a run counts as a page of its own. Both
    variants are counted in one window over a family's lines, which lie in one
    task already, so that runs are never shuffled.
    """
    apart = shuffled_lines(events.select("page", "line", "family", "new", *by), runs)
    w = Window.partitionBy("run", "page", "family").orderBy("line")

    def donors(first: int) -> Column:
        before = w.rangeBetween(first, -1)
        return F.when(F.col("new"), F.count_if(~F.col("new")).over(before)).otherwise(F.count_if("new").over(before)) > 0

    flags = apart.filter("family is not null and new is not null").select("run", *by, *[donors(n).alias(c) for c, n in (("page_donors", Window.unboundedPreceding), ("local3", -3), ("local10", -10))])
    sums = flags.groupBy("run", *by).agg(F.count("*").alias("targets"), *[F.count_if(c).cast("long").alias(c) for c in ("page_donors", "local3", "local10")])
    scopes = F.explode(F.array(*[F.struct(F.lit(c).alias("scope"), F.col(c).alias("with_donor")) for c in ("page_donors", "local3", "local10")]))
    # every run has all targets: their number is part of the group
    counts = sums.select("run", *by, "targets", scopes.alias("s")).select("run", *by, "targets", "s.*")
    rows = spread(counts, "with_donor", *by, "scope", "targets")
    return rows.select(*by, "scope", "observed", "mean", "low", "high", "p", "targets")


def replicates(pages: DataFrame, runs: int) -> DataFrame:
    """(run, stage, n, k) of pages (page, stage, n, k): run 0 is as observed, in the others pages are dealt to the stages anew.

    A stage keeps its number of pages. Pages are numbered in the order of their
    stages and in that of a digest of run and page, and the two numbers meet;
    no stage is sorted in one task.
    """
    slots = numbered(pages.select("stage", "page"), [F.col("stage").asc(), F.col("page").asc()], name="place").select("stage", "place")
    each = pages.select("page", F.col("stage").alias("own"), "n", "k", F.explode(F.sequence(F.lit(0), F.lit(runs))).alias("run"))
    mixed = [F.when(F.col("run") == 0, F.col("own")).asc(), F.when(F.col("run") > 0, F.md5(F.concat_ws(":", "run", "page"))).asc(), F.col("page").asc()]
    dealt = numbered(each, mixed, "run", name="place")
    return dealt.join(slots, "place").groupBy("run", "stage").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def parent_links(rows: DataFrame, id_col: str, parents: str, *carry: str) -> DataFrame:
    """One row per link from a row to each of its parents, with the carried columns of both (child_, parent_)."""
    child = rows.select(F.col(id_col).alias("child"), F.explode(parents).alias("parent"), *[F.col(c).alias(f"child_{c}") for c in carry])
    parent = rows.select(F.col(id_col).alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in carry])
    return child.join(parent, "parent")
