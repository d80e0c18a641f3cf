"""Matches of issues on shared points: collisions, matched points, candidates, mentions, fragments, scopes.

The results are classes with counts (see `pairing`); their SQL counts the pairs themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.operators import fragments, mentions, pairing
from weftline.plans.dialect import render
from weftline.plans.registry import _filled, frames, query
from weftline.plans.surrogates import NOW
from weftline.plans.views import view
from weftline.sources.tables import is_small, stored

#: Equal points of an issue; what a statement reads, not how they are matched.
VALUES = f"""
    select issue_id as id, 'reference' as point, reference as value from links
    union select c.issue_id, 'supplier', f.firm from claims c join (select id, {t.normalize_company_name('name')} as firm from companies) f on f.id = c.supplier_id where c.escalated
    union select issue_id, 'document', TEXT(canonical_key) from claims where claim_type = 'date'
    union select id, 'stakeholder', contact from issues
    union select c.issue_id, 'discovered:' || d.definition, TEXT(c.canonical_key) from claims c join definitions d on d.claim_type = c.claim_type where c.escalated"""
_READS = ["links", "claims", "companies", "issues", "definitions"]
#: Closed for longer than that, an issue isn't a candidate any more.
STALE = "not (state = 'done' and updated_at < :now - 365 * 86400)"


def _plain(spark, text: str, reads: list[str], **found: DataFrame) -> DataFrame:
    import re

    out = render(_filled(text, {"now": NOW}), True).replace("{", "{{").replace("}", "}}")
    for n in reads:
        out = re.sub(rf"\b(from|join) +{n}\b", r"\1 {%s}" % n, out)
    return spark.sql(out, **{n: found[n] for n in reads})


def reference_members(links: DataFrame, issues: DataFrame, open_only: bool) -> DataFrame:
    """Issues as members of their references' classes: the group is the project, and what counts is being open or all."""
    held = links.select(F.col("issue_id").alias("id"), F.col("reference").alias("value")).distinct()
    counts = (F.col("state") != "done") if open_only else F.lit(True)
    return held.join(issues.select("id", F.col("project_id").alias("grp"), F.coalesce(counts, F.lit(True)).alias("counts")), "id").withColumn("role", F.lit(pairing.ALL))


def open_reference_classes(links: DataFrame, issues: DataFrame) -> DataFrame:
    """reference, issue_id, project_id, class_id, n_open, n_links: open issues whose reference open issues of other projects have too.

    Two rows of one reference and different projects are a collision; a null project is none.
    """
    members = reference_members(links, issues, True).where("counts")
    found = pairing.classes(members, ["value"]).where("n_links > 0")
    return found.select(F.col("value").alias("reference"), F.col("id").alias("issue_id"), F.col("grp").alias("project_id"), "class_id", F.col("n_members").alias("n_open"), "n_links")


def reference_collisions(links: DataFrame, issues: DataFrame) -> DataFrame:
    """reference, issue_id, class_id, n_open, n_links of `open_reference_classes`."""
    return open_reference_classes(links, issues).drop("project_id")


def collision_classes(links: DataFrame, issues: DataFrame) -> DataFrame:
    """issue_id, reference, project_id, class_id, n_by_reference, n_links: issues in any state as members of the references they share.

    Two rows of one reference and different projects are a collision, and the references in which they are the shared ones.
    n_by_reference counts an issue's partners by that reference, n_links those by any, each once.
    """
    members = reference_members(links, issues, False)
    found = pairing.classes(members, ["value"]).where("n_links > 0")
    found = found.select(F.col("id").alias("issue_id"), F.col("value").alias("reference"), F.col("grp").alias("project_id"), "class_id", F.col("n_links").alias("n_by_reference"))
    return found.join(collisions_by_issue(links, issues), "issue_id")


def related_classes(links: DataFrame, issues: DataFrame) -> DataFrame:
    """issue_id, reference, is_open, class_id, n_by_reference, n_open: members of references that an open issue shares with another issue.

    A row's related issues are the other rows of its references with is_open. n_by_reference counts those of one reference, n_open
    those of any, each once.
    """
    members = reference_members(links, issues, True).withColumn("grp", F.lit(None).cast("long"))
    found = pairing.classes(members, ["value"]).where(F.col("n_links") + F.col("counts").cast("long") > 0)
    found = found.select(F.col("id").alias("issue_id"), F.col("value").alias("reference"), F.col("counts").alias("is_open"), "class_id", F.col("n_links").alias("n_by_reference"))
    return found.join(related_open(links, issues), "issue_id", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0).cast("long")))


def collisions_by_issue(links: DataFrame, issues: DataFrame) -> DataFrame:
    """issue_id, n_links: issues of other projects, in any state, that share a reference, each counted once."""
    return pairing.linked(reference_members(links, issues, False)).select(F.col("id").alias("issue_id"), "n_links")


def collisions_of(wanted: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """issue_id, other_id, shared: the colliding issues themselves, for the `wanted` (issue_id) ones, such as the one on show.

    The wanted issues' references are broadcast only after a check of their number.
    """
    members = reference_members(links, issues, False)
    mine = members.join(wanted.select(F.col("issue_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("issue_id"), F.col("grp").alias("my_grp"), "value")
    mine = F.broadcast(mine) if is_small(mine) else mine
    both = members.join(mine, "value").where("id <> issue_id").where(F.coalesce(F.col("grp") != F.col("my_grp"), F.lit(True)))
    return both.groupBy("issue_id", F.col("id").alias("other_id")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("shared"))


def related_open(links: DataFrame, issues: DataFrame) -> DataFrame:
    """issue_id, n_open: open issues, whatever their project, that share a reference, each counted once."""
    members = reference_members(links, issues, True).withColumn("grp", F.lit(None).cast("long"))
    return pairing.linked(members).select(F.col("id").alias("issue_id"), F.col("n_links").alias("n_open"))


@query("j01_reference_collisions", """
    with one as (select distinct l.reference, i.id, i.project_id from links l join issues i on l.issue_id = i.id where i.state <> 'done')
    select a.reference, a.id as issue_id, a.project_id, (select min(c.id) from one c where c.reference = a.reference) as class_id, (select count(*) from one c where c.reference = a.reference) as n_open, count(*) as n_links
    from one a join one b on a.reference = b.reference and a.id <> b.id and a.project_id <> b.project_id group by a.reference, a.id, a.project_id""")
def _j01(spark, sf_dir):
    return open_reference_classes(view(spark, sf_dir, "links"), view(spark, sf_dir, "issues"))


@query("j02_collisions_for_issue", """
    with held as (select distinct l.reference, i.id, i.project_id from links l join issues i on i.id = l.issue_id),
    pairs as (select a.id, a.reference, a.project_id, b.id as other_id from held a join held b on a.reference = b.reference and a.id <> b.id and coalesce(a.project_id <> b.project_id, true)),
    lows as (select reference, min(id) as class_id from held group by reference), totals as (select id, count(distinct other_id) as n_links from pairs group by id)
    select p.id as issue_id, p.reference, p.project_id, l.class_id, count(*) as n_by_reference, t.n_links from pairs p join lows l on l.reference = p.reference join totals t on t.id = p.id
    group by p.id, p.reference, p.project_id, l.class_id, t.n_links""")
def _j02(spark, sf_dir):
    return collision_classes(view(spark, sf_dir, "links"), view(spark, sf_dir, "issues"))


@query("j03_related_open_issues", """
    with held as (select distinct l.reference, i.id, i.state <> 'done' as is_open from links l join issues i on i.id = l.issue_id),
    pairs as (select a.id, a.reference, b.id as other_id from held a join held b on a.reference = b.reference and a.id <> b.id and b.is_open),
    by_reference as (select id, reference, count(*) as n from pairs group by id, reference), totals as (select id, count(distinct other_id) as n_open from pairs group by id),
    shared as (select reference, (select min(h.id) from held h where h.reference = p.reference) as class_id from pairs p group by reference)
    select h.id as issue_id, h.reference, h.is_open, s.class_id, coalesce(b.n, 0) as n_by_reference, coalesce(t.n_open, 0) as n_open from held h join shared s on s.reference = h.reference
    left join by_reference b on b.id = h.id and b.reference = h.reference left join totals t on t.id = h.id""")
def _j03(spark, sf_dir):
    return related_classes(view(spark, sf_dir, "links"), view(spark, sf_dir, "issues"))


def point_values(values: DataFrame, titles: DataFrame, descriptors: DataFrame, texts: DataFrame) -> DataFrame:
    """id, point, value, role of every point that is an equality: (id, point, value) `values`, substrings of titles and descriptors, mentions.

    titles is (id, title), descriptors (id, title) with one an id, texts (id, text). Where titles have a grp, substrings that one group
    alone has are left out: they link nothing. A mention names a supplier that any issue has; the issues
    that have the supplier match the one that names it.
    """
    equal = values.where("value is not null and value <> ''").select("id", "point", "value").distinct()
    apart = "grp" in titles.columns
    low = F.lower("title").alias("title")
    said = fragments.shared(titles.select("id", (F.col("grp") if apart else F.lit(None).cast("long")).alias("grp"), low), apart).withColumn("point", F.lit("subject_entity"))
    bought = fragments.shared_by_title(descriptors.select("id", low)).withColumn("point", F.lit("product_service"))
    parts = said.select("id", "point", "value").unionByName(bought.select("id", "point", "value"))
    suppliers = stored(equal.where("point = 'supplier'"), "suppliers")
    said = mentions.find(texts, suppliers.select(F.col("value").alias("name")).distinct()).select("id", F.col("name").alias("value"), F.lit(pairing.NAMES).alias("role"))
    named = said.select("value").distinct()
    owned = suppliers.join(named, "value", "left_semi").select("id", "value", F.lit(pairing.OWNS).alias("role"))
    across = said.unionByName(owned).groupBy("id", "value").agg(F.sum("role").cast("int").alias("role")).withColumn("point", F.lit("cross_mention"))
    whole = equal.unionByName(parts).withColumn("role", F.lit(pairing.ALL))
    return whole.unionByName(across.select(*whole.columns))


def _points(spark, sf_dir, stale: bool, grouped: bool):
    found = frames(spark, sf_dir, [*_READS, "descriptors", "issue_texts", "vetoes"])
    issues = found["issues"]
    values = _plain(spark, VALUES, _READS, **found)
    titles = issues.select("id", "title", *([F.col("project_id").alias("grp")] if grouped else []))
    descriptors = found["descriptors"].groupBy(F.col("issue_id").alias("id")).agg(F.min("descriptor").alias("title"))
    points = point_values(values, titles, descriptors, found["issue_texts"].select(F.col("issue_id").alias("id"), "text"))
    counts = F.expr(STALE.replace(":now", NOW)) if stale else F.lit(True)
    group = F.col("project_id") if grouped else F.lit(None).cast("long")
    items = issues.select("id", group.alias("grp"), counts.alias("counts"), F.round(F.col("value_amount") * 100).cast("long").alias("x"))
    return stored(points, "points"), items, found["vetoes"]


#: Every point of every issue, plainly: all substrings, and mentions by a look at each place of each name.
_PLAIN = f"""
    grams as (select distinct id, 'subject_entity' as point, substr(lower(title), p, 15) as value from (select id, title, UNNEST(SPAN(1, length(title) - 14)) as p from issues where length(title) >= 15) x
      union select distinct issue_id, 'product_service', substr(d, p, 15) from (select issue_id, min(descriptor) as d, UNNEST(SPAN(1, length(min(descriptor)) - 14)) as p from descriptors group by issue_id) y),
    held as (select point, value, JOINED(LIST(id), ',') as holders, count(*) as n from grams group by point, value),
    kept as (select point, min(value) as value from held where n > 1 group by point, holders),
    plain as materialized (select id, point, value from ({VALUES}) v where value <> '' union select g.id, g.point, g.value from grams g join kept k on g.point = k.point and g.value = k.value),
    firms as (select distinct value as name from plain where point = 'supplier' and length(value) >= 3),
    places as (select issue_id as id, lower(text) as low, name, UNNEST(SPAN(1, length(text) - length(name) + 1)) as p from issue_texts x join firms on contains(lower(text), name)),
    said as materialized (select distinct id, name from places where substr(low, p, length(name)) = name
      and LIKES(substr(low, greatest(p - 200, 1), least(200, p - 1) + length(name) + 200), '(subcontract|sub-contract|flow-down|flowdown|prime contract|teaming agreement|change order under|work order under)')),
    points as materialized (select id, point, value, 1 as names, 1 as owns from plain
      union all select coalesce(s.id, o.id), 'cross_mention', coalesce(s.name, o.value), case when s.id is not null then 1 else 0 end, case when o.id is not null then 1 else 0 end
      from said s full join (select id, value from plain where point = 'supplier' and value in (select name from said)) o on s.id = o.id and s.name = o.value),
    barred as materialized (select id_a, id_b from vetoes union select id_b, id_a from vetoes)"""


@query("j05_matched_points", f"""
    with {_PLAIN.strip()},
    pairs as (select a.id, a.point, a.value, b.id as other_id from points a join points b on a.point = b.point and a.value = b.value and a.id <> b.id and (a.names + b.owns = 2 or a.owns + b.names = 2)
      where not exists (select 1 from barred v where v.id_a = a.id and v.id_b = b.id)),
    lows as (select point, value, min(id) as class_id from points group by point, value),
    amounts as (select id, value_amount from issues where value_amount > 0)
    select p.id, p.point, p.value, l.class_id, count(*) as n_links from pairs p join lows l on p.point = l.point and p.value = l.value group by p.id, p.point, p.value, l.class_id
    union all select a.id, 'amount', null, null, count(*) from amounts a join amounts b on a.id <> b.id
      and abs(LONG(round(a.value_amount * 100, 0)) - LONG(round(b.value_amount * 100, 0))) * 100 <= greatest(LONG(round(a.value_amount * 100, 0)), LONG(round(b.value_amount * 100, 0)))
      where not exists (select 1 from barred v where v.id_a = a.id and v.id_b = b.id) group by a.id""")
def _j05(spark, sf_dir):
    return pairing.matched(*_points(spark, sf_dir, stale=False, grouped=False))


@query("j06_candidates", f"""
    with {_PLAIN.strip()},
    issue as (select id, project_id, LONG(round(value_amount * 100, 0)) as x, {STALE} as counts from issues),
    twice as (select a.id, a.point || ' + ' || b.point as point, a.value || ' + ' || b.value as value, least(a.names, b.names) as names, least(a.owns, b.owns) as owns from points a join points b on a.id = b.id and a.point < b.point),
    lows as (select point, value, min(id) as class_id from twice group by point, value),
    pairs as (select a.id, a.point, a.value, count(*) as n_links from twice a join twice b on a.point = b.point and a.value = b.value and a.id <> b.id and (a.names + b.owns = 2 or a.owns + b.names = 2)
      join issue i on i.id = a.id join issue j on j.id = b.id where i.project_id <> j.project_id and j.counts and not exists (select 1 from barred v where v.id_a = a.id and v.id_b = b.id) group by a.id, a.point, a.value),
    near as (select a.id, a.point, a.value, count(*) as n_links from points a join points b on a.point = b.point and a.value = b.value and a.id <> b.id and (a.names + b.owns = 2 or a.owns + b.names = 2)
      join issue i on i.id = a.id join issue j on j.id = b.id where i.project_id <> j.project_id and j.counts and i.x > 0 and j.x > 0 and abs(i.x - j.x) * 100 <= greatest(i.x, j.x) and not exists (select 1 from barred v where v.id_a = a.id and v.id_b = b.id) group by a.id, a.point, a.value)
    select p.id, p.point, p.value, l.class_id, p.n_links from pairs p join lows l on p.point = l.point and p.value = l.value
    union all select id, least(point, 'amount') || ' + ' || greatest(point, 'amount'), value, null, n_links from near""")
def _j06(spark, sf_dir):
    return pairing.candidates(*_points(spark, sf_dir, stale=True, grouped=True))


@query("j07_discovered_points", """
    with held as (select distinct c.issue_id as id, d.definition, TEXT(c.canonical_key) as value from claims c join definitions d on d.claim_type = c.claim_type where c.escalated)
    select a.definition, a.value, a.id, (select min(c.id) from held c where c.definition = a.definition and c.value = a.value) as class_id, count(*) as n_links from held a join held b on a.definition = b.definition and a.value = b.value and a.id <> b.id group by a.definition, a.value, a.id""")
def _j07(spark, sf_dir):
    """Issues that share a value of a confirmed definition; each definition tells which claims it is read from."""
    claims, definitions = view(spark, sf_dir, "claims"), view(spark, sf_dir, "definitions")
    held = claims.where("escalated").join(definitions, "claim_type").select(F.col("issue_id").alias("id"), "definition", F.col("canonical_key").cast("string").alias("value")).distinct()
    members = held.withColumns({"grp": F.lit(None).cast("long"), "counts": F.lit(True), "role": F.lit(pairing.ALL)})
    return pairing.classes(members, ["definition", "value"]).where("n_links > 0").select("definition", "value", "id", "class_id", "n_links")


@query("j08_cross_mention", f"""
    with firms as (select distinct {t.normalize_company_name('name')} as name from companies),
    words as (select * from (values (0, 'subcontract'), (1, 'sub-contract'), (2, 'subcontractor'), (3, 'flow-down'), (4, 'flowdown'), (5, 'prime contract'), (6, 'teaming agreement'), (7, 'change order under'), (8, 'work order under')) as t(k, keyword)),
    places as (select issue_id as id, lower(text) as low, name, UNNEST(SPAN(1, length(text) - length(name) + 1)) as p from issue_texts x join firms on contains(lower(text), name) where length(name) >= 3),
    hits as (select id, name, p, substr(low, greatest(p - 200, 1), least(200, p - 1) + length(name) + 200) as around from places where substr(low, p, length(name)) = name),
    told as (select id, name, p, min(k) as k from hits join words on contains(around, keyword) group by id, name, p),
    firsts as (select id, name, min(p) as p from told group by id, name)
    select f.id, f.name, w.keyword, LONG(f.p - 1) as at_ from firsts f join told t on t.id = f.id and t.name = f.name and t.p = f.p join words w on w.k = t.k""")
def _j08(spark, sf_dir):
    """Companies that an issue's text names near a word of a relationship."""
    names = _plain(spark, f"select distinct {t.normalize_company_name('name')} as name from companies", ["companies"], companies=view(spark, sf_dir, "companies"))
    return mentions.find(view(spark, sf_dir, "issue_texts").select(F.col("issue_id").alias("id"), "text"), names).withColumnRenamed("at", "at_")


def subject_fragments(titles: DataFrame) -> DataFrame:
    """id, project_id, value, n_values, class_id, n_projects of (id, project_id, title): projects with a title of another issue that shares 15 characters with the issue's.

    value is the first of the n_values substrings that the same issues share, class_id the smallest project that has it, n_projects how
    many do by another issue. A pair of an issue and a project is two rows of a value by different issues, and n_values added up over
    those values is the number of substrings that the pair shares; nothing is joined but counts.
    """
    found = fragments.shared(titles.select("id", F.col("project_id").alias("grp"), F.lower("title").alias("title")), projects=True)
    return found.select("id", F.col("grp").alias("project_id"), "value", "n_values", "class_id", "n_projects").where("n_projects > 0")


@query("j17_subject_fragments", """
    with grams as (select distinct id, project_id, substr(lower(title), p, 15) as value from (select id, project_id, title, UNNEST(SPAN(1, length(title) - 14)) as p from issues where length(title) >= 15) x),
    held as (select value, JOINED(LIST(id), ',') as holders, count(*) as n from grams group by value),
    kept as (select min(value) as value, count(*) as n_values from held where n > 1 group by holders)
    select a.id, a.project_id, a.value, k.n_values, min(l.class_id) as class_id, count(distinct b.project_id) as n_projects from grams a join kept k on a.value = k.value join grams b on b.value = a.value and b.id <> a.id
    join (select value, min(project_id) as class_id from grams group by value) l on l.value = a.value group by a.id, a.project_id, a.value, k.n_values""")
def _j17(spark, sf_dir):
    return subject_fragments(view(spark, sf_dir, "issues").select("id", "project_id", "title"))


def issues_to_check(issues: DataFrame, suppliers: DataFrame) -> DataFrame:
    """id, via, scope, n_related: the scope in which an issue's prerequisites are looked for.

    Its project, if it has one with other issues; else each of its suppliers ((id, supplier) rows) that other issues have;
    else the issue itself. The scope's members are the issues with the same via and scope, n_related the others in it.
    """
    sizes = issues.where("project_id is not null").groupBy("project_id").agg(F.count("*").alias("n")).where("n > 1")
    placed = issues.select("id", "project_id").join(sizes, "project_id", "left")
    in_project = placed.where("n is not null").select("id", F.lit("project").alias("via"), F.col("project_id").cast("string").alias("scope"), (F.col("n") - 1).alias("n_related"))
    alone = placed.where("n is null").select("id")
    held = suppliers.select("id", "supplier").distinct()
    shared = held.groupBy("supplier").agg(F.count("*").alias("n")).where("n > 1")
    by_supplier = alone.join(held, "id").join(shared, "supplier").select("id", F.lit("supplier").alias("via"), F.col("supplier").cast("string").alias("scope"), (F.col("n") - 1).alias("n_related"))
    itself = alone.join(by_supplier, "id", "left_anti").select("id", F.lit("itself").alias("via"), F.col("id").cast("string").alias("scope"), F.lit(0).cast("long").alias("n_related"))
    return in_project.unionByName(by_supplier).unionByName(itself)


def scope_members(issues: DataFrame, suppliers: DataFrame) -> DataFrame:
    """id, via, scope, n_related, asks: `issues_to_check`, and all other members of the suppliers that are looked through (asks is false).

    An issue's related issues are the other rows with its via and scope.
    """
    asked = issues_to_check(issues, suppliers).withColumn("asks", F.lit(True))
    by_supplier = asked.where("via = 'supplier'")
    held = suppliers.select("id", F.col("supplier").cast("string").alias("scope")).where("scope is not null").distinct()
    sizes = by_supplier.groupBy("scope").agg(F.max("n_related").alias("n_related"))
    others = held.join(sizes, "scope").join(by_supplier.select("id", "scope"), ["id", "scope"], "left_anti")
    return asked.unionByName(others.select("id", F.lit("supplier").alias("via"), "scope", "n_related", F.lit(False).alias("asks")))


@query("p18_issues_to_check", """
    with siblings as (select i.id, TEXT(i.project_id) as scope, count(*) as n from issues i join issues j on i.project_id = j.project_id and i.id <> j.id group by i.id, i.project_id),
    held as (select distinct issue_id as id, supplier_id from claims where escalated),
    shared as (select x.id, TEXT(x.supplier_id) as scope, count(*) as n from held x join held y on x.supplier_id = y.supplier_id and x.id <> y.id where x.id not in (select id from siblings) and x.id in (select id from issues) group by x.id, x.supplier_id)
    select id, 'project' as via, scope, n as n_related, true as asks from siblings union all select id, 'supplier', scope, n, true from shared
    union all select h.id, 'supplier', TEXT(h.supplier_id), s.n, false from held h join (select distinct scope, n from shared) s on s.scope = TEXT(h.supplier_id) where h.id not in (select id from shared)
    union all select id, 'itself', TEXT(id), 0, true from issues where id not in (select id from siblings) and id not in (select id from shared)""")
def _p18(spark, sf_dir):
    suppliers = view(spark, sf_dir, "claims").where("escalated").select(F.col("issue_id").alias("id"), F.col("supplier_id").alias("supplier"))
    return scope_members(view(spark, sf_dir, "issues"), suppliers)
