"""Joins: collisions, blocked candidate matching, lookups, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.operators.lookups import hot_keys, look_up
from weftline.plans.registry import Operator, frames, operator, query
from weftline.plans.surrogates import used
from weftline.sources.tables import stored

operator("j04_amount_band_pool", """
    with one as (select id, project_id, value_amount, LONG(floor(ln(value_amount) / ln(1.01e0))) as band from issues where value_amount > 0),
    near as (select id, project_id, value_amount, band, UNNEST(ARRAY(band - 1, band, band + 1)) as probe from one)
    select a.id as id_a, b.id as id_b from near a join one b on a.project_id = b.project_id and a.probe = b.band and a.id < b.id where abs(a.value_amount - b.value_amount) <= 0.01e0 * greatest(a.value_amount, b.value_amount)""")
operator("j09_path_company", "select distinct p.id, p.token from (select id, UNNEST(SPLIT(lower(url), '[^a-z0-9-]+')) as token from pages_) p join (select distinct token from (select UNNEST(SPLIT(lower(url), '[^a-z0-9-]+')) as token from pages_ where id % 10 = 0) y where length(token) >= 5) c on p.token = c.token")
ALIASES = operator("j10_alias_prefixes", f"""
    with names as (select distinct {t.entity_key('name')} as entity from companies), heads as (select entity, UNNEST(MAP_EACH(SPAN(4, length(entity) - 1), n, substr(entity, 1, cast(n as int)))) as head from names where length(entity) > 4)
    select a.entity as short_name, h.entity as long_name from names a join heads h on h.head = a.entity""")
operator("j11_prerequisite_satisfied", "select i.id, exists (select 1 from raw_items r where r.issue_id = i.id and r.signal_type = 'signup') as satisfied from issues i")
operator("j12_prerequisites", """
    with firsts as (select issue_id, signal_type, min(id) as id from raw_items where occurred_ts < :now_events - 2592000 + 86400 group by issue_id, signal_type)
    select f.issue_id, r.rule_id, f.id from firsts f join rules r on f.signal_type = r.trigger_type where not exists (select 1 from firsts g where g.issue_id = f.issue_id and g.signal_type = r.requires_type)""")
operator("j13_link_prerequisite", """
    with edges as (select id as from_id, id + 1 as to_id, case when id % 2 = 0 then 'depends_on' else 'blocks' end as kind from projects),
    needed as (select from_id as id, to_id as other_id from edges where kind = 'depends_on' union all select to_id, from_id from edges where kind = 'blocks')
    select n.id, n.other_id from needed n join projects p on p.id = n.other_id where p.status <> 'done'""")
operator("j14_bare_names", """
    with exact as (select lower(display_name) as k, count(*) as n, min(id) as id from parties group by 1), local_part as (select split_part(primary_email, '@', 1) as k, count(*) as n, min(id) as id from parties group by 1)
    select r.id, coalesce(case when e.n = 1 then e.id end, case when l.n = 1 then l.id end) as party_id from (select id, case when id % 2 = 0 then 'first' || TEXT(k % 40) || ' last' || TEXT(k % 60) else 'user' || TEXT(k) end as name from raw_items) r left join exact e on r.name = e.k left join local_part l on r.name = l.k""")
#: Links unlinked items, by the first that fits: the container's issue, a tag that names an open issue, an open issue with the reference, an
#: FYI's subject with a sender's domain known on the issue, a chat's sender, or a new cluster (minus the id of the item that opens it). An item
#: linked by tag, reference or sender, or to a new cluster, sets its container's issue for the later items there; a subject doesn't.
_PENDING = f"""select id, thread_key, pr_number_base, item_class, {t.normalize_subject('subject')} as subject_key, {t.sender_domain('from_actor')} as domain, split_part(from_actor, '@', 1) as local_part,
        source = 'teams_chat' and item_class in ('ACTIONABLE-ASK', 'WAITING-ON-OTHERS') as asks_in_chat, pr_number_base is not null or LIKES(from_actor, 'firm[0-3]') or contains(subject, 'PR1') or contains(body_preview, '/sites/') as real_signal,
        TOLONG(nullif(regexp_extract(body_preview, 'signed copy by Friday[?] About .([0-9]+)k', 1), '')) as tag from raw_items"""
_TABLES = {
    "open_issues": "select id, project_id from issues where state in ('active', 'waiting', 'blocked')",
    "by_reference": "select l.reference, min(o.id) as issue_id from links l join open_issues o on o.id = l.issue_id group by l.reference",
    "by_subject": f"select {t.normalize_subject('e.subject')} as subject_key, min(o.id) as issue_id from issue_evidence e join open_issues o on o.id = e.issue_id group by 1",
    "by_domain": "select distinct issue_id, domain from issue_evidence",
    "by_sender": "select p.local_part, min(o.id) as issue_id from (select split_part(primary_email, '@', 1) as local_part, min(id) as party_id from parties group by 1 having count(*) = 1) p join open_issues o on o.project_id = p.party_id group by p.local_part",
}
_LOOKUPS = f"""
    with pending as ({_PENDING}),
    {""",
    """.join(f"{name} as ({text})" for name, text in _TABLES.items())},
    matched as (select p.id, p.thread_key, p.item_class, p.asks_in_chat, p.real_signal, c.issue_id as by_container, g.id as by_tag, r.issue_id as by_reference, case when p.item_class = 'FYI-EVIDENCE' then d.issue_id end as by_subject, case when p.asks_in_chat then a.issue_id end as by_sender
      from pending p left join containers c on c.thread_key = p.thread_key left join open_issues g on g.id = p.tag left join by_reference r on r.reference = p.pr_number_base
      left join by_subject s on s.subject_key = p.subject_key left join by_domain d on d.issue_id = s.issue_id and d.domain = p.domain left join by_sender a on a.local_part = p.local_part)"""
_RULED = """select id, thread_key, coalesce(by_container, by_tag, by_reference, by_subject, by_sender, -id) as issue_id,
        case when item_class = 'NOISE' then 'noise' when by_container is not null then 'container' when by_tag is not null then 'tag' when by_reference is not null then 'reference' when by_subject is not null then 'subject'
          when item_class = 'FYI-EVIDENCE' and not real_signal then 'fyi_standalone' when by_sender is not null then 'sender' when asks_in_chat then 'chat_standalone' else 'new' end as rule from matched"""
_SETTERS = "select thread_key, min(id) as since, min_by(issue_id, id) as issue_id from ruled where rule in ('tag', 'reference', 'sender', 'new') group by thread_key"
_CASCADE = f"""{_LOOKUPS},
    ruled as ({_RULED}),
    setters as ({_SETTERS}),
    linked as (select r.id, r.issue_id, r.rule, case when r.rule not in ('noise', 'container') and r.id > s.since then s.issue_id end as later from ruled r left join setters s on s.thread_key = r.thread_key)
    select id, case when later is not null then 'container' else rule end as rule, case when later is not null then later when rule in ('noise', 'fyi_standalone', 'chat_standalone') then null else issue_id end as issue_id from linked"""
_LINKABLE = f"{_LOOKUPS} select m.*, p.pr_number_base as reference, o.id is not null as container_open from matched m join pending p on p.id = m.id left join open_issues o on o.id = m.by_container"


def _part(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    return Operator("part", text, tuple(frames), ())(spark, **frames)


def _matched(spark: SparkSession, containers: DataFrame, **frames: DataFrame) -> DataFrame:
    """The rows of `matched`, with a container's further columns and the item's reference; each key is looked up by `look_up`."""
    open_issues = _part(spark, _TABLES["open_issues"], issues=frames["issues"])
    by_reference = _part(spark, _TABLES["by_reference"], links=frames["links"], open_issues=open_issues)
    by_subject = _part(spark, _TABLES["by_subject"], issue_evidence=frames["issue_evidence"], open_issues=open_issues)
    by_domain = _part(spark, _TABLES["by_domain"], issue_evidence=frames["issue_evidence"])
    by_sender = _part(spark, _TABLES["by_sender"], parties=frames["parties"], open_issues=open_issues)

    pending = _part(spark, _PENDING, raw_items=frames["raw_items"]).withColumnRenamed("pr_number_base", "reference")
    pending = pending.withColumns({"subject_key": F.when(F.col("item_class") == "FYI-EVIDENCE", F.col("subject_key")), "local_part": F.when(F.col("asks_in_chat"), F.col("local_part"))})
    items = stored(pending, "pending")
    hot = hot_keys(items, ["thread_key"], ["tag"], ["reference"], ["subject_key", "domain"], ["local_part"])
    items = look_up(items, containers.withColumnRenamed("issue_id", "by_container"), ["thread_key"], hot)
    items = look_up(items, open_issues.select(F.col("id").alias("tag"), F.col("id").alias("by_tag")), ["tag"], hot)
    items = look_up(items, by_reference.withColumnRenamed("issue_id", "by_reference"), ["reference"], hot)
    items = look_up(items, by_subject.join(by_domain, "issue_id").select("subject_key", "domain", F.col("issue_id").alias("by_subject")), ["subject_key", "domain"], hot)
    return look_up(items, by_sender.withColumnRenamed("issue_id", "by_sender"), ["local_part"], hot).drop("tag", "subject_key", "domain", "local_part")


class Linkable(Operator):
    """What an item can be linked by, each looked up alone."""

    def __call__(self, spark: SparkSession, params: dict[str, str] | None = None, **frames: DataFrame) -> DataFrame:
        opened = _part(spark, _TABLES["open_issues"], issues=frames["issues"]).select(F.col("id").alias("issue_id"), F.lit(True).alias("opened"))
        containers = frames.pop("containers").select("thread_key", "issue_id").join(opened, "issue_id", "left")
        return _matched(spark, containers, **frames).withColumn("container_open", F.coalesce("opened", F.lit(False))).drop("opened")


LINKABLE = Linkable("linkable", _LINKABLE, tuple(used(_LOOKUPS)), ())


class Cascade(Operator):
    """The first rule that fits an item, and its container's issue where an earlier item has set it."""

    def __call__(self, spark: SparkSession, params: dict[str, str] | None = None, **frames: DataFrame) -> DataFrame:
        containers = frames.pop("containers").select("thread_key", "issue_id")
        ruled = stored(_part(spark, _RULED, matched=_matched(spark, containers, **frames)), "ruled")
        setters = _part(spark, _SETTERS, ruled=ruled).select("thread_key", "since", F.col("issue_id").alias("set_issue"))
        later = F.when(~F.col("rule").isin("noise", "container") & (F.col("id") > F.col("since")), F.col("set_issue"))
        linked = look_up(ruled, setters, ["thread_key"], hot_keys(ruled, ["thread_key"])).withColumn("later", later)
        issue = F.when(F.col("later").isNotNull(), F.col("later")).when(~F.col("rule").isin("noise", "fyi_standalone", "chat_standalone"), F.col("issue_id"))
        return linked.select("id", F.when(F.col("later").isNotNull(), "container").otherwise(F.col("rule")).alias("rule"), issue.alias("issue_id"))


CASCADE = Cascade("j15_link_cascade", _CASCADE, tuple(used(_CASCADE)), ())


@query("j15_link_cascade", _CASCADE)
def link_cascade(spark, sf_dir):
    return CASCADE(spark, **frames(spark, sf_dir, CASCADE.inputs))


operator("j16_sender_anchor", "select r.id, p.party_id from raw_items r join (select split_part(primary_email, '@', 1) as local_part, min(id) as party_id from parties group by 1) p on split_part(r.from_actor, '@', 1) = p.local_part where r.item_class = 'ACTIONABLE-ASK' and (r.pr_number_base is not null or contains(r.subject, 'PR'))")
operator("j18_value_corroborated", "select c.id from claims c where c.claim_type = 'commitment' and exists (select 1 from claims d where d.issue_id = c.issue_id and d.claim_type <> 'commitment' and round(d.amount / 1000e0, 0) = round(c.amount / 1000e0, 0))")
operator("j19_likely_reply", """
    with marked as (select id, issue_id, occurred_ts, direction, item_class, min(case when direction = 'outbound' then occurred_ts end) over (partition by issue_id order by occurred_ts range between 1e-6 following and 604800e0 following) as reply_ts from raw_items),
    replies as (select issue_id, occurred_ts, min(id) as id from raw_items where direction = 'outbound' group by issue_id, occurred_ts)
    select a.id, r.id as reply_id, round(a.reply_ts - a.occurred_ts, 3) as latency from marked a join replies r on r.issue_id = a.issue_id and r.occurred_ts = a.reply_ts where a.direction = 'inbound' and a.item_class = 'ACTIONABLE-ASK'""")
operator("j20_closure_signals", "select r.id, c.claim_id, case when c.n is null then 'no_open_claim' when c.n > 1 then 'ambiguous' else 'resolved' end as outcome from raw_items r left join (select issue_id % 150 as issue_id, count(*) as n, min(id) as claim_id from claims where status = 'open' and claim_type in ('ask', 'commitment') and escalated group by 1) c on c.issue_id = r.issue_id where r.signal_type = 'purchase'")
operator("j21_closure_without_request", """
    with firsts as (select issue_id, min(occurred_ts) as ts from raw_items where signal_type = 'click' group by issue_id)
    select r.id, r.issue_id from raw_items r left join firsts f on f.issue_id = r.issue_id where r.signal_type = 'purchase' and r.occurred_ts < :now_events - 2592000 + 2 * 86400 and (f.ts is null or f.ts >= r.occurred_ts)""")
operator("j22_orphans", """
    select 'claim' as kind, c.id from claims c where not exists (select 1 from issues i where i.id = c.issue_id and i.id % 11 <> 0)
    union all select 'issue', i.id from issues i where not exists (select 1 from claims c where c.issue_id = i.id)
    union all select 'link', l.issue_id from links l where not exists (select 1 from projects p where 'R' || TEXT(p.id) = l.reference)""", deal={"claims": ("issue_id",)})
operator("j23_actions_without_evidence", "select a.id from outcomes a where a.outcome = 'accepted' and not exists (select 1 from documents_ d where d.id = a.id and length(d.text) >= 1000)")
operator("j24_stray_clusters", """
    with anchors as (select project_id, owner, min(id) as issue_id from issues where id % 4 <> 0 group by project_id, owner having count(*) = 1)
    select a.id as cluster_id, b.issue_id from issues a join anchors b on a.project_id = b.project_id and a.owner = b.owner where a.id % 4 = 0""")
operator("j25_shared_lineage", "select canonical_key as lineage, count(distinct i.project_id) as n_projects from claims c join issues i on i.id = c.issue_id where c.escalated group by canonical_key having count(distinct i.project_id) >= 2")
operator("j26_triggered_experts", "select r.id, s.expert from raw_items r join (select * from (values ('legal', 'signed'), ('finance', 'invoice'), ('security', 'urgent'), ('finance', 'range')) as v(expert, keyword)) s on LIKES(' ' || lower(r.subject || ' ' || r.body_preview) || ' ', '[^a-z0-9]' || s.keyword || '[^a-z0-9]') group by r.id, s.expert")
operator("j27_search_evidence", "select id, issue_id from claims where ANY_OF(ARRAY(:terms), w, contains(lower(text), w))", terms="'part 13 ', 'worth $44k'")
operator("j28_deep_links", "select c.id, 'https://mail.example/item/' || TEXT(r.id) as link, r.occurred_ts from claims c left join raw_items r on r.id = c.raw_item_id where c.claim_type = 'date'")
operator("j29_shared_supplier", f"""
    with named as (select id, {t.normalize_company_name('name')} as name from companies), shared as (select name, min(id) as first_id, count(distinct id) as n from named group by name having count(distinct id) >= 2)
    select n.id, s.first_id, s.n, s.name from named n join shared s on n.name = s.name""")
operator("j30_full_text_search", """
    with wanted as (select UNNEST(ARRAY(:terms)) as w),
    hits as (select id, w, count(*) as tf from (select id, UNNEST(FILTER(EXTRACT_ALL(lower(text), '([a-z]+)', 1), w, CONTAINS(ARRAY(:terms), w))) as w from documents_) x group by id, w),
    sizes as (select count(*) as n from documents_), spread as (select w, count(*) as df from hits group by w)
    select h.id, round(sum(h.tf / (h.tf + 1.2e0) * ln(1e0 + (s.n - p.df + 0.5e0) / (p.df + 0.5e0))), 6) as relevance from hits h join wanted q on h.w = q.w join spread p on p.w = h.w cross join sizes s group by h.id having count(*) = SIZE(ARRAY(:terms))""", terms="'the', 'and', 'that'")
operator("j31_projects_by_recipients", "select distinct i.project_id from parties p join issues i on i.project_id = p.id where lower(p.primary_email) in (:addresses) and i.state <> 'done'", addresses="'user10@home.example', 'user25@home.example', 'nobody@x.example'")
operator("j32_projects_of_conversation", "select r.thread_key, i.project_id, max(r.occurred_ts) as last_ts from raw_items r join issues i on i.id = r.issue_id * 7 + r.k % 3 group by r.thread_key, i.project_id")
operator("j33_issue_parties", "select r.issue_id, lower(w) as email, count(*) as n from (select issue_id, UNNEST(ARRAY(from_actor, 'user' || TEXT(k) || '@home.example')) as w from raw_items) r group by r.issue_id, lower(w)")
