"""Operators that are not single plans: folds, graph merges, upserts, text diffs, verdict tables."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.registry import query
from weftline.plans.views import view, work_dir

# --- folds -----------------------------------------------------------------------------------------------------


def greedy_budget(items: DataFrame, group: str, score: str, ts: str, key: str, cost: str, budget: int) -> DataFrame:
    """Per group, the items that a greedy pass by (score desc, ts desc, key) takes under a budget.

    An item that doesn't fit is skipped and the pass goes on; the first one is always taken. Costs are 1 or more.
    Of the items of one cost no more can be taken than fit the budget, and of those beyond the budget only the first,
    so each group's fold sees a number of items that only the budget bounds.
    """
    beyond = F.least(F.col(cost), F.lit(budget + 1))
    best = Window.partitionBy(group, beyond).orderBy(F.desc(score), F.desc(ts), key)
    items = items.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= F.greatest(F.lit(1), F.lit(budget) / F.col(cost)))
    order = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), (-F.col(ts)).alias("t"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        fits = (F.size(acc["taken"]) == 0) | (acc["used"] + x["c"] <= budget)
        return F.when(fits, F.struct((acc["used"] + x["c"]).alias("used"), F.concat(acc["taken"], F.array(x["k"].cast("long"))).alias("taken"))).otherwise(acc)

    return items.groupBy(group).agg(F.aggregate(order, start, step).alias("r")).select(group, F.posexplode("r.taken").alias("place", key))


@query("l01_assemble_evidence", """
    with items as (select issue_id, id, amount as score, first_seen_ts as ts, greatest(1, length(text) // 4) as cost from claims),
    lists as (select issue_id, list({'used': cost, 'taken': [id]} order by score desc, ts desc, id) as steps from items group by issue_id),
    folded as (select issue_id, list_reduce(steps, lambda a, x: case when a.used + x.used <= 30 then {'used': a.used + x.used, 'taken': list_concat(a.taken, x.taken)} else a end).taken as taken from lists)
    select issue_id, cast(unnest(range(len(taken))) as int) as place, unnest(taken) as id from folded""")
def assemble_evidence(spark, sf_dir):
    items = view(spark, sf_dir, "claims").select("issue_id", "id", "first_seen_ts", F.col("amount").alias("score"), F.greatest(F.lit(1), F.expr("length(text) div 4")).alias("cost"))
    return greedy_budget(items, "issue_id", "score", "first_seen_ts", "id", "cost", 30)


def clamped_fold(steps: DataFrame, key: str, order: str, step: str, low: int, high: int, start: int, block: int = 4096) -> DataFrame:
    """key, value, n: `start` moved by each step in the order of a whole number, held at `high` on the way up and at `low` on the way down.

    A run of steps acts as one move held between two bounds, and such moves compose. So runs of `block` numbers fold to
    one move each, runs of those again, and a key of any size never meets in one task as a list of its rows.
    """
    moves = steps.select(key, F.col(order).cast("long").alias("at"), F.col(step).cast("long").alias("d"), F.when(F.col(step) < 0, low).cast("long").alias("lo"), F.when(F.col(step) > 0, high).cast("long").alias("hi"), F.lit(1).cast("long").alias("n"))

    def held(v, m):
        return F.least(m["hi"], F.greatest(v, m["lo"]))  # a bound that is null is left out

    def then(a, b):
        """One move, then the other."""
        lo = F.when(a["lo"].isNotNull(), held(a["lo"] + b["d"], b)).otherwise(b["lo"])
        hi = F.when(a["hi"].isNotNull(), held(a["hi"] + b["d"], b)).otherwise(b["hi"])
        return F.struct((a["d"] + b["d"]).alias("d"), lo.alias("lo"), hi.alias("hi"), (a["n"] + b["n"]).alias("n"))

    def folded(m, *by):
        row = F.array_sort(F.collect_list(F.struct("at", "d", "lo", "hi", "n")))
        nothing = F.struct(F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(0).cast("long").alias("n"))
        return m.groupBy(key, *by).agg(F.aggregate(row, nothing, then).alias("m"))

    for _ in range(2):
        moves = folded(moves, F.expr(f"at div {block}").alias("at")).select(key, "at", "m.*")
    whole = folded(moves).select(key, "m.*")
    return whole.select(key, held(F.lit(start).cast("long") + F.col("d"), {"lo": F.col("lo"), "hi": F.col("hi")}).alias("value"), "n")


@query("m14_trust_fold", """
    select action_kind, round(list_reduce(list_prepend(50, list(case when outcome = 'accepted' then 10 else -15 end order by id, outcome = 'accepted')), lambda t, s: case when s > 0 then least(90, t + s) else greatest(10, t + s) end) / 100e0, 6) as trust, cast(count(*) as bigint) as n
    from outcomes group by action_kind""")
def trust_fold(spark, sf_dir):
    """Trust per situation: every confirmation adds 0.1 up to 0.9, every rejection takes 0.15 down to 0.1, in order; of one id rejections come first."""
    seen = view(spark, sf_dir, "outcomes").select("action_kind", "id", F.when(F.col("outcome") == "accepted", 10).otherwise(-15).alias("step"))
    return clamped_fold(seen, "action_kind", "id", "step", 10, 90, 50).select("action_kind", F.round(F.col("value") / 100, 6).alias("trust"), "n")


@query("m11_tiered_answer", """
    with best as (select issue_id, case claim_type when 'decision' then 1 when 'commitment' then 2 else 3 end as tier, max(amount) as amount, arg_max(id, (amount, -id)) as id from claims group by 1, 2),
    placed as (select *, row_number() over (partition by issue_id order by case when amount >= 40000 then tier else 9 end, amount desc, id, tier desc) as place from best)
    select issue_id, tier, amount from placed where place = 1""")
def tiered_answer(spark, sf_dir):
    """The first tier, in order, whose best score reaches the band; the best of all where none does."""
    claims = view(spark, sf_dir, "claims")
    tier = F.when(F.col("claim_type") == "decision", 1).when(F.col("claim_type") == "commitment", 2).otherwise(3)
    best = claims.groupBy("issue_id", tier.alias("tier")).agg(F.max(F.struct("amount", (-F.col("id")).alias("k"))).alias("b"))
    ranked = best.groupBy("issue_id").agg(F.min(F.when(F.col("b.amount") >= 40000, F.struct("tier", "b"))).alias("first"), F.max(F.struct("b", "tier")).alias("top"))
    return ranked.select("issue_id", F.coalesce("first.tier", "top.tier").alias("tier"), F.coalesce("first.b.amount", "top.b.amount").alias("amount"))


# --- merges and upserts ----------------------------------------------------------------------------------------


def merged_groups(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(a, b) pairs -> (node, root): the smallest member of each connected group, by contraction in stored rounds.

    Each round draws an order of the nodes, gives every node the first of itself and its neighbours, and goes on with those and the
    different pairs between them. A share of the nodes goes each round whatever the graph's shape, so all rounds together move
    a few times what the first does. On the way back each node gets the root of the node that stands for it.
    """
    folder, rounds = work_dir(spark), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}{len(rounds)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pairs = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    low = None  # of each node, the smallest of those it stands for
    while not pairs.isEmpty():
        def drawn(c, salt=len(rounds)):
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("draw"), F.col(c).alias("id"))

        ends = pairs.select(F.col("a").alias("node"), drawn("b").alias("near")).unionAll(pairs.select(F.col("b").alias("node"), drawn("a").alias("near")))
        chosen = kept(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("near", drawn("node"))["id"].alias("rep")), "chosen")
        level = chosen.withColumn("low", F.col("node")) if low is None else kept(low.join(chosen, "node", "left").select("node", "rep", "low"), "level")
        low = kept(level.where("rep is not null").groupBy(F.col("rep").alias("node")).agg(F.min("low").alias("low")), "low")
        of_a, of_b = (chosen.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
        ties = pairs.where("a <> b").join(of_a, "a").join(of_b, "b").where("rep_a <> rep_b")
        rounds.append(level)
        pairs = kept(ties.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), "pairs")
    if low is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = low.withColumnRenamed("low", "root")
    for level in reversed(rounds):
        roots = level.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("node", F.coalesce("root", "low").alias("root"))
    return roots


@query("d11_merge_issues")
def merge_issues(spark, sf_dir):
    """Issues that share a reference, directly or through others, with the smallest of their group; each is tied to its reference's smallest."""
    links = view(spark, sf_dir, "links")
    first = links.groupBy("reference").agg(F.min("issue_id").alias("b"))
    return merged_groups(links.join(first, "reference").select(F.col("issue_id").alias("a"), "b").where("a <> b"), spark)


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str], touch: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """MERGE semantics as one full outer join: rows of `current` touched by `fresh`, and the new ones inserted."""
    c, f = current.alias("c"), fresh.alias("f")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    out = c.join(f, on, "full_outer")
    cols = []
    for name in current.columns:
        old, new = F.col(f"c.{name}"), F.col(f"f.{name}")
        both = F.col(f"c.{keys[0]}").isNotNull() & F.col(f"f.{keys[0]}").isNotNull()
        cols.append((F.when(both, touch[name](old, new)).otherwise(F.coalesce(old, new)) if name in touch else F.coalesce(old, new)).alias(name))
    return out.select(*cols)


@query("d05_materialize_fresh", """
    with old_rows as (select issue_id, claim_type, canonical_key, min(first_seen_ts) as first_ts, max(last_seen_ts) as last_ts from claims where raw_item_id % 3 > 0 group by 1, 2, 3),
    new_rows as (select issue_id, claim_type, canonical_key, min(first_seen_ts) as first_ts, max(last_seen_ts) as last_ts from claims where raw_item_id % 3 < 2 and id % 2 = 0 group by 1, 2, 3)
    select coalesce(o.issue_id, n.issue_id) as issue_id, coalesce(o.claim_type, n.claim_type) as claim_type, coalesce(o.canonical_key, n.canonical_key) as canonical_key,
      coalesce(o.first_ts, n.first_ts) as first_ts, case when o.issue_id is not null and n.issue_id is not null then greatest(o.last_ts, n.last_ts) else coalesce(o.last_ts, n.last_ts) end as last_ts
    from old_rows o full outer join new_rows n on o.issue_id = n.issue_id and o.claim_type = n.claim_type and o.canonical_key = n.canonical_key""")
def materialize_fresh(spark, sf_dir):
    claims = view(spark, sf_dir, "claims")
    keys = ["issue_id", "claim_type", "canonical_key"]

    def state(df):
        return df.groupBy(*keys).agg(F.min("first_seen_ts").alias("first_ts"), F.max("last_seen_ts").alias("last_ts"))

    return upsert(state(claims.where("raw_item_id % 3 > 0")), state(claims.where("raw_item_id % 3 < 2 and id % 2 = 0")), keys, {"last_ts": F.greatest})



# --- text that needs more than SQL ------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which neither engine has as a function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


@query("f02b_nfkc_entity_key", "select id, lower('A' || name) as result from companies")
def nfkc_entity_key(spark, sf_dir):
    names = view(spark, sf_dir, "companies").select("id", F.concat(F.lit("Ａ"), "name").alias("name"))
    return names.select("id", F.lower(nfkc("name")).alias("result"))


@query("f13_labelled_party", r"""
    with found as (select id, regexp_extract(body_preview, 'Owner: ([^\n]+)', 1) as value from raw_items)
    select id, case when value <> '' and not starts_with(value, 'Due') then value end as result from found""")
def labelled_party(spark, sf_dir):
    """A labelled value that isn't itself another label (negative look-ahead)."""
    items = view(spark, sf_dir, "raw_items")
    return items.select("id", F.expr(r"nullif(regexp_extract(body_preview, r'Owner: (?!Due)([^\n]+)', 1), '')").alias("result"))


@query("f19_amount_candidates", r"""
    with found as (select id, body_preview, unnest(regexp_extract_all(body_preview, '[$][0-9]+( - [$][0-9]+)?[km]?')) as hit from raw_items),
    placed as (select id, hit, cast(strpos(body_preview, hit) as int) as place, case right(hit, 1) when 'm' then 1e6 when 'k' then 1e3 else 1e0 end as scale,
        regexp_matches(lower(substr(body_preview, greatest(1, strpos(body_preview, hit) - 40), length(hit) + 80)), 'about|range|order') as preferred from found)
    select id, place, cast(unnest(regexp_extract_all(hit, '[0-9]+')) as double) * scale as amount, preferred from placed""")
def amount_candidates(spark, sf_dir):
    """Dollar figures, both ends of a range scaled by its suffix, with whether a cue word stands within 40 characters."""
    items = view(spark, sf_dir, "raw_items")
    found = items.select("id", "body_preview", F.explode(F.expr(r"regexp_extract_all(body_preview, r'([$][0-9]+(?: - [$][0-9]+)?[km]?)', 1)")).alias("hit"))
    at = F.expr("instr(body_preview, hit)")
    near = F.lower(F.expr("substring(body_preview, greatest(1, instr(body_preview, hit) - 40), length(hit) + 80)"))
    scale = F.when(F.col("hit").endswith("m"), 1e6).when(F.col("hit").endswith("k"), 1e3).otherwise(1.0)
    amounts = F.transform(F.expr(r"regexp_extract_all(hit, r'([0-9]+)', 1)"), lambda v: v.cast("double"))
    return found.select("id", at.alias("place"), F.explode(amounts).alias("raw"), scale.alias("scale"), near.rlike("(about|range|order)").alias("preferred")).select("id", "place", (F.col("raw") * F.col("scale")).alias("amount"), "preferred")


def paragraph_diff(pairs: DataFrame) -> DataFrame:
    """(id, old, new) -> id, kind (added, removed, changed, unchanged), n: paragraph-wise comparison."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, old, new in zip(batch["id"], batch["old"], batch["new"], strict=True):
                a, b = ([p.strip() for p in (t or "").split("\n") if p.strip()] for t in (old, new))
                counts = dict.fromkeys(("added", "removed", "changed", "unchanged"), 0)
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    if tag == "equal":
                        counts["unchanged"] += i2 - i1
                    else:
                        changed = min(i2 - i1, j2 - j1)
                        counts["changed"] += changed
                        counts["removed"] += i2 - i1 - changed
                        counts["added"] += j2 - j1 - changed
                rows += [(key, k, n) for k, n in counts.items()]
            yield pd.DataFrame(rows, columns=["id", "kind", "n"])

    return pairs.mapInPandas(run, "id long, kind string, n long")


@query("n07_compare_attachments")
def compare_attachments(spark, sf_dir):
    docs = view(spark, sf_dir, "documents_")
    return paragraph_diff(docs.select("id", F.col("text").alias("old"), F.regexp_replace("text", "(?m)^The .*$", "Changed.").alias("new")))


def _severity(a: str, b: str) -> float:
    return round(1 - difflib.SequenceMatcher(None, a, b).ratio(), 4)


@lru_cache(maxsize=50_000)
def _severity_of_short(a: str, b: str) -> float:
    """Short texts that a worker has met need no second comparison; it keeps the last of these pairs."""
    return _severity(a, b)


@F.pandas_udf(T.DoubleType())
def rewrite_severity(suggested: pd.Series, sent: pd.Series) -> pd.Series:
    """1 less the similarity ratio of two texts, to four places; pass another function of two series to replace it."""
    pairs = ((a or "", b or "") for a, b in zip(suggested, sent, strict=True))
    return pd.Series([(_severity_of_short if len(a) + len(b) < 1000 else _severity)(a, b) for a, b in pairs])


def spread(df: DataFrame, rows: int = 25_000) -> DataFrame:
    """df in parts of some `rows` rows, for steps whose time a row is long: a file's bytes alone would make a few long tasks."""
    return df.repartition(max(1, -(-df.count() // rows)))


@query("u03_rewrite_severity")
def rewrite_severities(spark, sf_dir):
    return spread(view(spark, sf_dir, "raw_items").select("id", "subject", "body_preview")).select("id", rewrite_severity("subject", F.lower("body_preview")).alias("severity"))


@query("n01_date_mentions", """
    select id, case when id % 2 = 0 then 'next week ' || k else 'by ' || k end as text, case when id % 2 <> 0 and k is not null then '2024-02-01' end as resolved, id % 2 <> 0 and k is not null as hard from raw_items""")
def date_mentions(spark, sf_dir):
    """A JSON element that is a text or a struct: (id, text, resolved date, hard)."""
    raw = view(spark, sf_dir, "raw_items").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit('"next week '), F.col("k"), F.lit('"'))).otherwise(F.concat(F.lit('{"text": "by '), "k", F.lit('", "date": "2024-02-01", "hard": true}'))).alias("entry"))
    parsed = raw.select("id", F.from_json("entry", "text string, date string, hard boolean").alias("s"), F.expr("try_cast(from_json('[' || entry || ']', 'array<string>')[0] as string)").alias("plain"))
    hard = F.coalesce(F.col("s.hard"), F.lit(False))
    return parsed.select("id", F.coalesce("s.text", "plain").alias("text"), F.when(hard, F.col("s.date")).alias("resolved"), hard.alias("hard"))



# --- verdict tables in place of model calls ---------------------------------------------------------------------


@query("u01_judged_candidates", """
    select id_a, min(id_b) as id_b from (select l.issue_id as id_a, m.issue_id as id_b from links l join links m on l.reference = m.reference and l.issue_id < m.issue_id where (l.issue_id + m.issue_id) % 3 = 0) x group by id_a""")
def judged_candidates(spark, sf_dir):
    """Candidate pairs joined with a table of verdicts; the smallest confirmed partner of each."""
    links = view(spark, sf_dir, "links")
    pairs = links.select(F.col("issue_id").alias("id_a"), "reference").join(links.select(F.col("issue_id").alias("id_b"), "reference"), "reference").where("id_a < id_b")
    verdicts = pairs.select("id_a", "id_b", F.when((F.col("id_a") + F.col("id_b")) % 3 == 0, "SAME").otherwise("DIFFERENT").alias("verdict"))
    return verdicts.where("verdict = 'SAME'").groupBy("id_a").agg(F.min("id_b").alias("id_b"))


@query("u05_proposals", "select substr(lower(subject), 1, 64) as definition_id, count(*) as n from raw_items group by 1 having count(*) >= 5 and min(id) % 2 = 1")
def proposals(spark, sf_dir):
    """Observations over the bar whose deterministic id isn't among the known definitions."""
    seen = view(spark, sf_dir, "raw_items").groupBy(F.substring(F.lower("subject"), 1, 64).alias("definition_id")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    known = seen.where("first_id % 2 = 0").select("definition_id")
    return seen.where("n >= 5").join(known, "definition_id", "left_anti").select("definition_id", "n")


@query("u06_batched_enrichment")
def batched_enrichment(spark, sf_dir, size: int = 50):
    """Rows enriched by a function of a batch of `size`; here a stand-in that numbers the batch's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                yield part.assign(summary="status of " + part["name"].str.lower(), batch_rows=len(part))

    return view(spark, sf_dir, "projects").select("id", "name").mapInPandas(run, "id long, name string, summary string, batch_rows long")


@query("u07_rule_candidates", """
    select distinct a.signal_type as requires_type, b.signal_type as trigger_type from raw_items a join raw_items b on a.id + 1 = b.id where a.signal_type <> b.signal_type and a.k % 4 = 0 and a.signal_type in ('signup', 'click', 'view')""")
def rule_candidates(spark, sf_dir):
    """Proposed rules kept only with high confidence, two known and different types, and an allowed scope."""
    items = view(spark, sf_dir, "raw_items")
    a = items.select(F.col("id").alias("x"), F.col("signal_type").alias("requires_type"), F.when(F.col("k") % 4 == 0, "high").otherwise("low").alias("confidence"))
    b = items.select((F.col("id") - 1).alias("x"), F.col("signal_type").alias("trigger_type"))
    known = spark.createDataFrame([("signup",), ("click",), ("view",)], "requires_type string")
    return a.join(b, "x").where("confidence = 'high' and requires_type <> trigger_type").join(known, "requires_type", "left_semi").select("requires_type", "trigger_type").distinct()
