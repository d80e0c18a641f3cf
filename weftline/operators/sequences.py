"""Recurring sequences of stages in closed projects, and where an open project departs from them.

A project's stages are its distinct signal types by their first occurrence. Candidates are the contiguous windows of any
project's stages; a project supports a candidate that its stages hold in that order, gaps allowed. Projects of one
category with equal stages are one shape with a count, so a course that a third of all projects took costs one row.
Candidates grow a stage at a time from stored projections (a shape and the place of its last match), and what too few
projects support isn't grown: every prefix of a window is a window with at least its support.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.plans.views import view
from weftline.sources.tables import removed, stored


def histories(projects: DataFrame, items: DataFrame) -> DataFrame:
    """project, category and stages of `projects` (project, category), from `items` (project, signal_type, occurred_ts).

    Items without a type or a time have no stage; a project without stages has an empty list. A list is as long as the
    vocabulary of types at most. Types that first occur at the same time are in order of their names.
    """
    first = items.where("project is not null and signal_type is not null and occurred_ts is not null").groupBy("project", "signal_type").agg(F.min("occurred_ts").alias("ts"))
    stages = first.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "signal_type"))), lambda s: s["signal_type"]).alias("stages"))
    return projects.select("project", "category").join(stages, "project", "left").withColumn("stages", F.coalesce("stages", F.array().cast("array<string>")))


def _windows(shapes: DataFrame, length: int) -> DataFrame:
    """Each category's windows of a length, as what comes before the last stage, and that stage."""
    long = shapes.where(F.size("stages") >= length)
    window = F.explode(F.transform(F.sequence(F.lit(1), F.size("stages") - length + 1), lambda at: F.slice("stages", at, length)))
    return long.select("category", window.alias("w")).select("category", F.slice("w", 1, length - 1).alias("pattern"), F.element_at("w", -1).alias("token")).distinct()


def _supported(projections: DataFrame, least: int) -> DataFrame:
    """The patterns that `least` projects hold. Their evidence is hashed by sums that need no list of projects."""
    kinds = [F.bit_xor(F.xxhash64("stages", F.lit(salt))) for salt in (1, 2)]
    return projections.groupBy("category", "pattern").agg(F.sum("n").alias("support"), F.struct(F.sum("n"), F.count("*"), *kinds).alias("evidence")).where(F.col("support") >= least)


def patterns(closed: DataFrame, shortest: int = 3, longest: int = 5, least: int = 2) -> DataFrame:
    """category, steps (a list), support and total (the category's projects) of the sequences that recur in `closed`.

    `closed` has project, category and stages, a row each; projects without a category take no part. Categories of fewer
    than `least` projects have no patterns. Of patterns with the same projects the longest stay. Sets of projects are
    told apart by their number, their number of shapes and 128 bits of hashes. An empty table gives no rows.
    """
    scratch = [stored(closed.where("category is not null").groupBy("category", "stages").agg(F.count("*").alias("n")), "shapes")]
    shapes, kept = scratch[0], []
    grown = shapes.select("*", F.posexplode("stages").alias("last", "token")).select("category", "stages", "n", F.array("token").alias("pattern"), (F.col("last") + 1).alias("last"))
    for length in range(2, longest + 1):
        grown = grown.join(_windows(shapes, length), ["category", "pattern"]).withColumn("at", F.array_position("stages", F.col("token"))).where("at > last")
        grown = stored(grown.select("category", "stages", "n", F.concat("pattern", F.array("token")).alias("pattern"), F.col("at").alias("last")), "projections")
        scratch.append(grown)
        frequent = _supported(grown, least)
        if length >= shortest:
            kept.append(frequent.withColumn("length", F.lit(length)))
        grown = grown.join(frequent.select("category", "pattern"), ["category", "pattern"], "left_semi")
    found = stored(reduce(DataFrame.unionByName, kept), "patterns")
    scratch.append(found)
    most = found.groupBy("category", "evidence").agg(F.max("length").alias("length"))
    total = shapes.groupBy("category").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    out = stored(found.join(most, ["category", "evidence", "length"], "left_semi").join(total, "category").select("category", F.col("pattern").alias("steps"), "support", "total"), "sequences")
    removed(scratch)
    return out


def deviations(opened: DataFrame, found: DataFrame) -> DataFrame:
    """Where projects depart from the strongest pattern of their category: the first step they lack, with those around it.

    The strongest has the most support, then the most steps, then comes first by its steps. A step is lacking if the
    project's stages don't have it after the steps before. Projects that hold the whole pattern have no row, nor have
    those of a category without patterns.
    """
    order = F.struct(-F.col("support"), -F.size("steps"), "steps")
    best = found.groupBy("category").agg(F.min_by(F.struct("steps", "support", "total"), order).alias("best")).select("category", "best.*")
    places = F.transform("steps", lambda s: F.array_position("stages", s))
    gap = F.array_position(F.transform("places", lambda p, i: p <= F.when(i > 0, F.get("places", i - 1)).otherwise(0)), True)
    out = opened.join(best, "category").withColumn("places", places).withColumn("gap", gap.cast("int")).where("gap > 0")
    step = {"missing_step": F.col("gap") - 1, "preceding_step": F.col("gap") - 2, "following_step": F.col("gap")}
    return out.select("project", "category", *(F.get("steps", at).alias(name) for name, at in step.items()), "support", "total")


_STAGES = """
    stage as (select user_id as project, event_type as t, min(epoch(ts)) as first from events where user_id is not null and event_type is not null and ts is not null group by all),
    courses as (select project, list(t order by first, t) as s from stage group by project),
    ends as (select user_id as project, arg_max(event_type, (ts, event_id)) = 'purchase' as closed from events where user_id is not null group by user_id),
    courses_of as (select e.project, e.closed, c.c_mktsegment as category, coalesce(q.s, []) as s from ends e join customer c on c.c_custkey = e.project left join courses q on q.project = e.project),
    history as (select * from courses_of where {closed}),
    candidates as (select distinct category, s[i:i + k - 1] as p from history, unnest(range(1, len(s) + 1)) a(i), (values (3), (4), (5)) b(k) where i + k - 1 <= len(s)),
    counted as (select c.category, c.p, count(*) as support, list(h.project order by h.project) as who from candidates c join history h on h.category = c.category and list_filter(h.s, lambda x: list_contains(c.p, x)) = c.p group by c.category, c.p having count(*) >= 2),
    longest as (select *, max(len(p)) over (partition by category, who) as most from counted),
    found as (select l.category, l.p, l.support, t.total from longest l join (select category, count(*) as total from history group by category) t on t.category = l.category where len(l.p) = l.most)"""


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's items as a project in its customer's segment, closed if its last item is a purchase."""
    items = view(spark, sf_dir, "raw_items").select(F.col("issue_id").alias("project"), "id", "signal_type", "occurred_ts")
    ends = items.where("project is not null").groupBy("project").agg((F.max_by("signal_type", F.struct("occurred_ts", "id")) == "purchase").alias("closed"))
    projects = ends.join(view(spark, sf_dir, "projects").select(F.col("id").alias("project"), "category"), "project")
    return histories(projects, items).join(ends, "project")


@query("a24_sequence_patterns", f"with {_STAGES.format(closed='true')} select category, array_to_string(p, '>') as pattern, cast(support as bigint) as support, total from found")
def sequence_patterns(spark, sf_dir):
    return patterns(_threads(spark, sf_dir)).select("category", F.array_join("steps", ">").alias("pattern"), "support", "total")


@query("a24b_sequence_deviations", f"""
    with {_STAGES.format(closed='closed')},
    best as (select category, p, support, total from (select *, row_number() over (partition by category order by support desc, len(p) desc, p) as r from found) x where r = 1),
    walked as (select o.project, b.*, list_max(list_filter(range(0, len(b.p) + 1), lambda k: list_filter(o.s, lambda x: list_contains(b.p[1:k], x)) = b.p[1:k])) as held from courses_of o join best b on b.category = o.category where not o.closed)
    select project, category, p[held + 1] as missing_step, case when held > 0 then p[held] end as preceding_step, p[held + 2] as following_step, support, total from walked where held < len(p)""")
def sequence_deviations(spark, sf_dir):
    threads = stored(_threads(spark, sf_dir), "threads")
    return deviations(threads.where("not closed"), patterns(threads.where("closed")))
