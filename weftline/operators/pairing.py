"""Items that match on shared values, as classes with counts in place of pairs.

All items that hold a value are a class; an item's links are the class's other members, and they are counted by
aggregates, so a value that every item holds costs one row an item. What is an inequality (amounts near each other) is
counted by running sums in bands. Pairs are made only for items of very many values, value by value in cells of one
block of holders each.

A member is a row of id, grp (items of one group don't match each other; null is no group), counts (may be a partner),
role (1: names the value, 2: is the value's, 3: both; those who name it match those whose it is) and the class's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import gathered
from weftline.sources.tables import stored

#: Values of an item up to which its partners are counted by the subsets of its values.
WIDEST = 8
#: Blocks that the holders of a value are dealt to where pairs are made.
CELLS = 16
#: Length of a substring that two titles must share.
GRAM = 15
ALL, NAMES, OWNS = 3, 1, 2


def _partners(prefix: str) -> Column:
    """Of a class's counts by role, those whom the member's role matches."""
    return F.when(F.col("role") == NAMES, F.col(f"{prefix}_owns")).when(F.col("role") == OWNS, F.col(f"{prefix}_names")).otherwise(F.col(f"{prefix}_all"))


def _by_role(weight: Column) -> list[Column]:
    return [
        F.sum(weight).alias("all"), F.sum(F.when(F.col("role") != OWNS, weight).otherwise(0)).alias("names"), F.sum(F.when(F.col("role") != NAMES, weight).otherwise(0)).alias("owns"),
    ]


def classes(members: DataFrame, key: list[str], vetoes: DataFrame | None = None) -> DataFrame:
    """The members of classes of two and more, with class_id (the smallest id), n_members and n_links.

    n_links counts the partners: other members that count, in another group, whose role fits. Pairs of `vetoes` (id_a,
    id_b) in either order aren't partners. A hot value's rows are added up before they move, and joined with one row.
    """
    weight = F.col("counts").cast("long")
    own = members.groupBy(*key, "grp").agg(F.count("*").alias("n"), F.min("id").alias("low"), *_by_role(weight))
    whole = own.groupBy(*key).agg(F.sum("n").alias("n_members"), F.min("low").alias("class_id"), *(F.sum(c).alias(f"w_{c}") for c in ("all", "names", "owns"))).where("n_members > 1")
    own = own.where("grp is not null").select(*key, "grp", *(F.col(c).alias(f"o_{c}") for c in ("all", "names", "owns")))
    out = members.join(whole, key).join(own, [*key, "grp"], "left")
    itself = F.when(F.col("role") == ALL, weight).otherwise(0)
    out = out.withColumn("n_links", _partners("w") - F.coalesce(_partners("o"), itself)).select(*members.columns, "class_id", "n_members", "n_links")
    return out if vetoes is None else _without(out, vetoes, key, F.lit(True))


def classes_once(members: DataFrame, key: list[str]) -> DataFrame:
    """As `classes`, with one exchange: for members of which no class is too large for a task."""
    weight = F.col("counts").cast("long")
    group, whole = Window.partitionBy(*key, "grp"), Window.partitionBy(*key)
    of_role = {"all": weight, "names": F.when(F.col("role") != OWNS, weight).otherwise(0), "owns": F.when(F.col("role") != NAMES, weight).otherwise(0)}
    out = members.withColumns({f"w_{c}": F.sum(w).over(whole) for c, w in of_role.items()} | {"n_members": F.count("*").over(whole), "class_id": F.min("id").over(whole)}).where("n_members > 1")
    out = out.withColumns({f"o_{c}": F.sum(w).over(group) for c, w in of_role.items()})  # after the whole class, whose exchange does for groups
    itself = F.when(F.col("role") == ALL, weight).otherwise(0)
    mine = F.when(F.col("grp").isNull(), itself).otherwise(_partners("o"))
    return out.withColumn("n_links", _partners("w") - mine).select(*members.columns, "class_id", "n_members", "n_links")


def marked(items: DataFrame, vetoes: DataFrame) -> DataFrame:
    """The items with barred: whether a veto names them. Only barred members take part in the search for vetoed partners."""
    named = vetoes.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("barred", F.lit(True))
    return items.join(named, "id", "left").withColumn("barred", F.coalesce("barred", F.lit(False)))


def _without(counted: DataFrame, vetoes: DataFrame, key: list[str], near: Column) -> DataFrame:
    """n_links less the vetoed partners; `near` is a condition on x and other_x.

    The counted members are stored, since they are read three times.
    """
    counted, free = stored(counted, "counted"), None
    if "barred" in counted.columns:
        counted, free = counted.where("barred"), counted.where("not barred")
    both = vetoes.select("id_a", "id_b").unionByName(vetoes.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).where("id_a <> id_b").distinct()
    mine = counted.select(*key, F.col("id").alias("id_a"), "grp", "role", *(["x"] if "x" in counted.columns else []))
    theirs = counted.where("counts").select(*key, F.col("id").alias("id_b"), F.col("grp").alias("other_grp"), F.col("role").alias("other_role"), *([F.col("x").alias("other_x")] if "x" in counted.columns else []))
    lost = both.join(mine, "id_a").join(theirs, [*key, "id_b"]).where(F.coalesce(F.col("grp") != F.col("other_grp"), F.lit(True))).where((F.col("role") != F.col("other_role")) | (F.col("role") == ALL)).where(near)
    lost = lost.groupBy(*key, F.col("id_a").alias("id")).agg(F.count("*").alias("lost"))
    less = counted.join(lost, [*key, "id"], "left").withColumn("n_links", F.col("n_links") - F.coalesce("lost", F.lit(0))).select(*counted.columns)
    return less if free is None else free.unionByName(less)


def linked(members: DataFrame, widest: int = WIDEST) -> DataFrame:
    """id, n_links: with how many others (that count, in other groups) an item shares any value, each once.

    Of items with few values, by inclusion and exclusion over the subsets of their values; of items with more than `widest`,
    as distinct pairs with the holders of their values, made in cells. Items without partners aren't there.
    """
    shared = members.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    held = members.join(shared, "value", "left_semi").groupBy("id", "grp", "counts", "role").agg(F.array_sort(F.collect_set("value")).alias("held"))
    few = held.where(F.size("held") <= widest)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("held")) - 1)
    subsets = few.withColumn("subset", F.explode(F.transform(masks, lambda m: F.filter("held", lambda v, k: F.call_function("shiftright", m, k) % 2 == 1))))
    signed = classes(subsets.drop("held"), ["subset"]).withColumn("n_links", F.when(F.size("subset") % 2 == 1, F.col("n_links")).otherwise(-F.col("n_links")))
    counted = signed.groupBy("id").agg(F.sum("n_links").alias("n_links"))

    many = held.where(F.size("held") > widest)
    dealt = held.select("id", "grp", "counts", F.size("held").alias("size"), F.explode("held").alias("value")).withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(CELLS)).cast("int"))
    wide = many.select(F.col("id").alias("wide"), F.col("grp").alias("wide_grp"), F.col("counts").alias("wide_counts"), F.explode("held").alias("value")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    pairs = wide.join(dealt, ["value", "cell"]).where("wide <> id").where(F.coalesce(F.col("grp") != F.col("wide_grp"), F.lit(True))).select("wide", "wide_counts", "id", "counts", "size").distinct()
    own = pairs.where("counts").groupBy(F.col("wide").alias("id")).agg(F.count("*").alias("n_links"))
    back = pairs.where("wide_counts").where(F.col("size") <= widest).groupBy("id").agg(F.count("*").alias("n_links"))
    return counted.unionByName(own).unionByName(back).groupBy("id").agg(F.sum("n_links").alias("n_links")).where("n_links > 0")


def near_counts(points: DataFrame, key: list[str], weights: list[str]) -> DataFrame:
    """key, x and, for each weight, its sum over the points of the same key whose x differs by 1 % of the larger or less.

    x is a whole number over 0, such as an amount in cents. Points of one x are added up first; then running sums in bands
    of 1 % give what lies before either end of an x's interval, and whole bands in between are added from their totals.
    """
    band = F.floor(F.log(F.col("x")) / F.log(F.lit(1.01)))
    at = points.where("x > 0").groupBy(*key, "x").agg(*(F.sum(w).alias(w) for w in weights))
    low, high = F.expr("x - x div 100"), F.expr("x * 100 div 99")
    none = [F.lit(0).cast("long").alias(w) for w in weights]
    events = at.select(*key, F.col("x").alias("of"), "x", F.lit(1).alias("turn"), *weights)
    events = events.unionByName(at.select(*key, F.col("x").alias("of"), low.alias("x"), F.lit(0).alias("turn"), *none)).unionByName(at.select(*key, F.col("x").alias("of"), high.alias("x"), F.lit(2).alias("turn"), *none))
    events = events.withColumn("band", band)
    run = Window.partitionBy(*key, "band").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0)
    ends = events.select(*key, "of", "band", "turn", *(F.sum(w).over(run).alias(w) for w in weights)).where("turn <> 1")
    ends = ends.select(*key, "of", "band", "turn", *(F.when(F.col("turn") == 0, -F.col(w)).otherwise(F.col(w)).alias(w) for w in weights))
    totals = events.where("turn = 1").groupBy(*key, "band").agg(*(F.sum(w).alias(w) for w in weights))
    spans = ends.groupBy(*key, "of").agg(F.min("band").alias("first"), F.max("band").alias("last")).where("first < last")
    spans = spans.withColumn("band", F.explode(F.sequence(F.col("first"), F.col("last") - 1))).join(totals, [*key, "band"]).select(*key, "of", *weights)
    return ends.select(*key, "of", *weights).unionByName(spans).groupBy(*key, F.col("of").alias("x")).agg(*(F.sum(w).alias(w) for w in weights))


def near(members: DataFrame, key: list[str], vetoes: DataFrame | None = None) -> DataFrame:
    """The members (with x) and n_links: partners of the same key whose x differs by 1 % of the larger or less."""
    weight = F.col("counts").cast("long")
    marked = members.where("x > 0").withColumns({"all": weight, "names": F.when(F.col("role") != OWNS, weight).otherwise(0), "owns": F.when(F.col("role") != NAMES, weight).otherwise(0)})
    names = ["all", "names", "owns"]
    whole = near_counts(marked, key, names).select(*key, "x", *(F.col(c).alias(f"w_{c}") for c in names))
    several = marked.where("grp is not null").groupBy(*key, "grp").agg(F.count("*").alias("n")).where("n > 1").select(*key, "grp")
    own = near_counts(marked.join(several, [*key, "grp"], "left_semi"), [*key, "grp"], names).select(*key, "grp", "x", *(F.col(c).alias(f"o_{c}") for c in names))
    out = members.join(whole, [*key, "x"]).join(own, [*key, "grp", "x"], "left")
    itself = F.when(F.col("role") == ALL, weight).otherwise(0)
    out = out.withColumn("n_links", _partners("w") - F.coalesce(_partners("o"), itself)).select(*members.columns, "n_links")
    close = F.expr("abs(x - other_x) * 100 <= greatest(x, other_x)")
    return out if vetoes is None else _without(out, vetoes, key, close)


def grams(titles: DataFrame, size: int = GRAM) -> DataFrame:
    """id, value, each once: the substrings of `size` of (id, title). Two titles share a substring of that length or more where they share a value."""
    at = lambda title: F.sequence(F.lit(1), F.length(title) - (size - 1))
    parts = F.transform("titles", lambda title: F.transform(at(title), lambda p: F.substring(title, p, F.lit(size))))
    of_id = titles.where(F.length("title") >= size).groupBy("id").agg(F.collect_set("title").alias("titles"))
    return of_id.select("id", F.explode(F.array_distinct(F.flatten(parts))).alias("value"))


def fewest(values: DataFrame, key: list[str]) -> DataFrame:
    """(id, value) rows of the values that two or more hold, with n_values; of values with the same holders, only the first one's.

    n_values is the number of values with those holders. Holders are compared by their number and two sums of hashes. Neighbouring substrings of a title
    mostly have the same holders, and what a whole collection shares leaves one value.
    """
    hashed = [F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")]
    held = values.groupBy(*key, "value").agg(F.count("*").alias("n"), *hashed).where("n > 1")
    firsts = held.groupBy(*key, "n", "h1", "h2").agg(F.min("value").alias("value"), F.count("*").alias("n_values")).select(*key, "value", "n_values")
    return values.join(firsts, [*key, "value"])


#: Members of a class up to which one task may take it whole.
HOT = 100_000
#: Buckets that values are counted in by their hash; only those of buckets with more than HOT rows are counted one by one.
BUCKETS = 1 << 16
#: Rows of points that a task gets where classes come to tasks whole.
TASK_ROWS = 200_000


def _kinds(values: DataFrame) -> DataFrame:
    """point, k: the points by the mean size of their classes, smallest first."""
    sizes = values.groupBy("point").agg((F.count("*") / F.approx_count_distinct("value")).alias("size"))
    return stored(sizes.select("point", F.row_number().over(Window.orderBy("size", "point")).alias("k")), "kinds")


def _hot(coded: DataFrame) -> DataFrame:
    """k, value, h: classes of more than HOT members, numbered; at most one for each HOT rows. Rare values don't move for it."""
    bucket = F.pmod(F.xxhash64("k", "value"), F.lit(BUCKETS)).cast("int")
    busy = coded.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket")
    sizes = coded.withColumn("bucket", bucket).join(F.broadcast(busy), "bucket", "left_semi").groupBy("k", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    return stored(sizes.select("k", "value", F.row_number().over(Window.orderBy("k", "value")).alias("h")), "hot")


def _coded(values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """The values as id, k, value, role and h (the number of a hot class), their `_kinds` and `_hot` (None: no class is hot), and how many tasks they call for."""
    kinds = _kinds(values)
    coded = values.join(F.broadcast(kinds), "point").select("id", "k", "value", "role")
    hot = _hot(coded)
    coded = coded.join(F.broadcast(hot), ["k", "value"], "left").select("id", "k", "value", "role", "h")
    tasks = max(values.sparkSession.sparkContext.defaultParallelism, -(-values.count() // TASK_ROWS))
    return coded, kinds, hot if hot.limit(1).count() else None, tasks


def _vetoed(items: DataFrame, vetoes: DataFrame) -> DataFrame:
    """The items with vetoed: the partners that are barred (null: none)."""
    both = vetoes.select("id_a", "id_b").unionByName(vetoes.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).where("id_a <> id_b")
    return items.join(both.groupBy(F.col("id_a").alias("id")).agg(F.collect_set("id_b").alias("vetoed")), "id", "left")


def _whole(rows: DataFrame, tasks: int, single: bool) -> DataFrame:
    """id, k, value, other_k, other, class_id, n_links: counted where a class's rows are, which move once."""
    return rows.repartition(tasks, "k", "value").sortWithinPartitions("value", "k").mapInArrow(gathered.links(single), gathered.OUT)


def matched(values: DataFrame, items: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Matched points: id, point, value, class_id, n_links of every item and value (of an amount: without value and class) with a partner.

    `values` has id, point, value and role, `items` id, grp, counts and x (an amount in cents, may be null). Classes of up to
    HOT members are counted where their rows come together, the others by aggregates.
    """
    coded, kinds, hot, tasks = _coded(values)
    rows = coded.where("h is null").join(_vetoed(items.select("id", "grp", "counts", F.lit(None).cast("long").alias("x")), vetoes), "id")
    equal = _whole(rows, tasks, single=True).select("id", "k", "value", "class_id", "n_links")
    items = marked(items, vetoes)
    if hot is not None:
        most = classes(coded.where("h is not null").join(items.select("id", "grp", "counts", "barred"), "id").select("id", "grp", "counts", "barred", "role", "h"), ["h"], vetoes)
        equal = equal.unionByName(most.where("n_links > 0").join(F.broadcast(hot), "h").select("id", "k", "value", "class_id", "n_links"))
    equal = equal.join(F.broadcast(kinds), "k").select("id", "point", "value", "class_id", "n_links")
    amounts = items.where("x > 0").select("id", "grp", "counts", "barred", F.lit(ALL).alias("role"), "x", F.lit("amount").alias("point"))
    amounts = near(amounts, ["point"], vetoes).where("n_links > 0")
    return equal.unionByName(amounts.select("id", "point", F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("class_id"), "n_links"))


def _among_hot(coded: DataFrame, items: DataFrame, vetoes: DataFrame, hot: DataFrame, tasks: int) -> DataFrame:
    """As `_whole` for two hot classes, and for a hot class and an amount, by aggregates. `coded` has hot values only."""
    items = marked(items, vetoes)
    held = coded.repartition(tasks, "id").groupBy("id").agg(F.collect_list(F.struct("k", "role", "h")).alias("held"))
    each = held.join(items.select("id", "grp", "counts", "barred"), "id").select("id", "grp", "counts", "barred", "held", F.explode("held").alias("a"))
    two = each.select("id", "grp", "counts", "barred", "a", F.explode(F.filter("held", lambda b: b["k"] > F.col("a.k"))).alias("b"))
    two = two.select("id", "grp", "counts", "barred", F.col("a.role").bitwiseAND(F.col("b.role")).alias("role"), F.col("a.h").alias("h"), F.col("b.h").alias("other_h"))
    two = classes(two, ["h", "other_h"], vetoes).where("n_links > 0").select("id", "h", "other_h", "class_id", "n_links")
    priced = coded.join(items.where("x > 0"), "id").select("id", "grp", "counts", "barred", "role", "h", "x")
    priced = near(stored(priced, "priced"), ["h"], vetoes).where("n_links > 0")
    found = two.unionByName(priced.select("id", "h", F.lit(None).cast("int").alias("other_h"), F.lit(None).cast("long").alias("class_id"), "n_links"))
    others = hot.select(F.col("h").alias("other_h"), F.col("k").alias("other_k"), F.col("value").alias("other"))
    found = found.join(F.broadcast(hot), "h").join(F.broadcast(others), "other_h", "left")
    return found.select("id", "k", "value", "other_k", "other", "class_id", "n_links")


def candidates(values: DataFrame, items: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Candidates, which share two points: id, point, value, class_id, n_links for every two points that an item shares with others.

    Points and values of the two are joined by ' + '. The class of a value and an amount isn't one (nearness of amounts isn't
    transitive) and has no class_id; its partners are those of the value's class whose amount is near.

    An item goes once to each of its values, with those of its other values that are more frequent as a rule, and there all
    of the class's pairs are counted. Classes of more than HOT members are only taken along; what two of them share, or one and
    an amount, is counted by aggregates.
    """
    coded, kinds, hot, tasks = _coded(values)
    held = coded.repartition(tasks, "id").groupBy("id").agg(F.collect_list(F.struct("k", "value", "role", "h")).alias("held"))
    held = held.join(_vetoed(items.select("id", "grp", "counts", "x"), vetoes), "id")
    each = held.select("id", "grp", "counts", "x", "vetoed", "held", F.explode("held").alias("a")).where("a.h is null")
    beside = F.filter("held", lambda b: (b["k"] != F.col("a.k")) & (b["h"].isNotNull() | (b["k"] > F.col("a.k"))))
    each = each.select("id", "grp", "counts", "x", "vetoed", "a.k", "a.value", "a.role", beside.alias("beside")).where("x > 0 or size(beside) > 0")
    each = each.select("id", "grp", "counts", "x", "vetoed", "k", "value", "role", F.transform("beside", lambda b: b["k"] * 4 + b["role"]).alias("codes"), F.col("beside.value").alias("others"))
    found = _whole(each, tasks, single=False)
    if hot is not None:
        found = found.unionByName(_among_hot(coded.where("h is not null").select("id", "k", "role", "h"), items, vetoes, hot, tasks))
    found = found.join(F.broadcast(kinds), "k").join(F.broadcast(kinds.select(F.col("point").alias("beside"), F.col("k").alias("other_k"))), "other_k", "left")
    found = found.withColumn("beside", F.coalesce("beside", F.lit("amount")))
    value = F.when(F.col("other").isNull(), F.col("value")).when(F.col("point") < F.col("beside"), F.concat_ws(" + ", "value", "other")).otherwise(F.concat_ws(" + ", "other", "value"))
    return found.select("id", F.concat_ws(" + ", F.least("point", "beside"), F.greatest("point", "beside")).alias("point"), value.alias("value"), "class_id", "n_links")
