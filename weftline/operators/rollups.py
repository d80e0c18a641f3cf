"""Aggregations over the work graph."""

from __future__ import annotations

from weftline.functions import text as t
from weftline.plans.registry import operator

operator("a01_value_at_risk", """
    with per_issue as (select id, value_amount from issues where state <> 'done' and value_amount >= 1000),
    top as (select id, value_amount, row_number() over (order by value_amount desc, id) as place from (select id, value_amount from per_issue order by value_amount desc, id limit 5) x)
    select 'total' as kind, cast(null as bigint) as id, round(sum(value_amount), 2) as amount, count(*) as n from per_issue
    union all select 'top', id, value_amount, place from top""")
operator("a02_staleness_baselines", """
    select category, greatest(3e0, round(MEDIAN(gap), 6)) as baseline_days, count(*) as n_gaps
    from (select category, (updated_at - lag(updated_at) over (partition by category, project_id order by updated_at, id)) / 86400e0 as gap from issues) x
    where gap > 0 group by category having count(*) >= 8""")
operator("a03_escalation_senders", "select issue_id, count(distinct case when direction = 'inbound' and item_class in ('ACTIONABLE-ASK', 'WAITING-ON-OTHERS') then lower(trim(from_actor)) end) as n_senders from raw_items group by issue_id")
operator("a04_conflicting_values", """
    with per_item as (select issue_id, raw_item_id, max(amount) as amount, min(id) as id from claims group by issue_id, raw_item_id),
    per_amount as (select issue_id, amount, min(id) as id from per_item group by issue_id, amount)
    select issue_id, amount, id from (select issue_id, amount, id, count(*) over (partition by issue_id) as n from per_amount) x where n >= 2""")
operator("a05_value_amount", "select issue_id, coalesce(max(case when claim_type = 'commitment' then amount end), max(case when claim_type <> 'decision' then amount end), 0e0) as amount from claims group by issue_id")
operator("a06_ask_density", "select issue_id, count_if(claim_type = 'ask' and status = 'open') as n_asks from claims group by issue_id")
operator("a07_suppliers", """
    select p.company, count_if(i.state <> 'done') as n_open, count(i.id) as n_issues, round(sum(i.value_amount), 2) as total_value, bool_or(i.has_unmet_prerequisite) as gated, max(i.updated_at) as last_ts
    from parties p join issues i on p.id = i.project_id where p.company <> '' group by p.company order by n_open desc, last_ts desc, company""")
operator("a08_weekly_scorecard", """
    select p.company, count_if(i.opened_at > :now - 604800) as opened_7d, count_if(i.state = 'done' and i.updated_at > :now - 604800) as closed_7d, count_if(i.state <> 'done') as open_now, round(sum(case when i.state <> 'done' then i.value_amount else 0e0 end), 2) as open_value
    from parties p join issues i on p.id = i.project_id group by p.company""")
operator("a09_last_closed_for_company", "select p.company, max_by(i.id, i.updated_at * 1000000 + i.id) as id, round(max(i.updated_at) / 86400e0, 2) as closed_day from parties p join issues i on p.id = i.project_id where i.state = 'done' group by p.company")
operator("a10_digest", """
    select count_if(state <> 'done') as n_open, count_if(state = 'waiting') as n_waiting, count_if(state = 'done' and updated_at > :now - 604800) as closed_week, count_if(opened_at > :now - 604800) as opened_week,
      count_if(state <> 'done' and due < :now) as overdue, round(sum(case when state <> 'done' then value_amount else 0e0 end), 2) as open_value from issues""")
operator("a11_monthly_signal_trends", """
    with spine as (select MONTH(m) as month_key from (select UNNEST(MONTHS(cast('2024-01-31' as timestamp), 3)) as m) x),
    kinds as (select distinct signal_type from raw_items), counted as (select MONTH(occurred_at) as month_key, signal_type, count(*) as n from raw_items group by 1, 2)
    select s.month_key, k.signal_type, coalesce(c.n, 0) as n from spine s cross join kinds k left join counted c on s.month_key = c.month_key and k.signal_type = c.signal_type""")
operator("a12_todo_summary", "select claim_type, owner, count(*) as n, count(distinct issue_id) as n_issues, count(*) > 40 as cut_off from claims where status = 'open' group by claim_type, owner")
operator("a13_duplicate_asks_in_project", """
    with texts as (select i.project_id, c.claim_type, c.canonical_key, c.issue_id, min(c.text) as low, max(c.text) as high from claims c join issues i on c.issue_id = i.id where c.status = 'open' group by i.project_id, c.claim_type, c.canonical_key, c.issue_id)
    select project_id, claim_type, canonical_key, count(*) as n_issues, case when min(low) = max(high) then 'duplicate' else 'conflicting' end as verdict, JOINED(MAP_EACH(LIST(issue_id), v, TEXT(v)), ',') as issue_list
    from texts group by project_id, claim_type, canonical_key having count(*) >= 2""")
operator("a14_contradictory_owners", "select issue_id, claim_type, canonical_key % 50 as key, count(distinct owner) as n_owners from claims where status = 'open' group by issue_id, claim_type, canonical_key % 50 having count(distinct owner) >= 2")
operator("a15_stale_active_projects", "select p.id, max(i.updated_at) as last_ts from projects p left join issues i on p.id = i.project_id where p.status = 'active' group by p.id having max(i.updated_at) is null or max(i.updated_at) < :now - 30 * 86400")
operator("a16_done_projects_with_commitments", "select p.id, count(*) as n_open from projects p join issues i on p.id = i.project_id join claims c on c.issue_id = i.id where p.status = 'done' and c.claim_type = 'commitment' and c.status = 'open' group by p.id")
operator("a17_resolved_but_open", "select i.id, count(*) as n_claims from issues i join claims c on i.id = c.issue_id where i.state in ('active', 'waiting') group by i.id having count_if(c.status = 'open') = 0")
operator("a18_closed_with_open_claims", "select c.id, c.issue_id from claims c join issues i on c.issue_id = i.id where i.state = 'done' and c.status = 'open'")
operator("a19_identity_conflicts", "select l.reference, count(distinct i.project_id) as n_projects, count(distinct i.id) as n_issues from links l join issues i on l.issue_id = i.id group by l.reference having count(distinct i.project_id) >= 2 order by n_projects desc, reference")
operator("a20_supplier_entities", f"select entity, count(distinct project_id) as n_projects, JOINED(MAP_EACH(SET(project_id), v, TEXT(v)), ',') as project_list from (select {t.normalize_company_name('s.name')} as entity, i.project_id from companies s join claims c on c.supplier_id = s.id join issues i on i.id = c.issue_id where c.escalated) x group by entity having count(distinct project_id) >= 2")
operator("a21_candidate_rules", """
    with firsts as (select thread_key, signal_type, min(occurred_ts) as ts from raw_items group by thread_key, signal_type)
    select a.signal_type as requires_type, b.signal_type as trigger_type, count(*) as observed, count_if(a.ts < b.ts) as consistent, count(*) >= 2 and bool_and(a.ts < b.ts) as holds
    from firsts a join firsts b on a.thread_key = b.thread_key and a.signal_type <> b.signal_type group by a.signal_type, b.signal_type""")
operator("a22_occurrences_by_group", "select thread_key, count(*) as n, round(min(occurred_ts), 3) as first_ts, round(max(occurred_ts), 3) as last_ts from raw_items where signal_type = 'error' group by thread_key")
operator("a23_gate_board", """
    with has as (select distinct issue_id, signal_type from raw_items where occurred_ts < :now_events - 2592000 + 86400),
    unmet as (select h.issue_id, min(r.rule_id) as rule_id from has h join rules r on h.signal_type = r.trigger_type where not exists (select 1 from has q where q.issue_id = h.issue_id and q.signal_type = r.requires_type) group by h.issue_id)
    select r.rule_id, count(u.issue_id) as n_gated from rules r left join unmet u on r.rule_id = u.rule_id group by r.rule_id""")
operator("a25_stage_sequence", """
    select thread_key, JOINED(MAP_EACH(LIST(step), w, split_part(w, '#', 2)), '>') as stages
    from (select thread_key, lpad(TEXT(row_number() over (partition by thread_key order by min(occurred_ts), signal_type)), 3, '0') || '#' || signal_type as step from raw_items group by thread_key, signal_type) x group by thread_key""")
operator("a26_accuracy_metrics", "select count(*) as n, count_if(outcome = 'accepted') as accepted, count_if(rewritten) as rewritten, round(FLOAT(count_if(outcome = 'accepted')) / nullif(count(*), 0), 6) as accepted_rate, round(FLOAT(count_if(rewritten)) / nullif(count_if(outcome = 'accepted'), 0), 6) as rewrite_rate from outcomes")
operator("a27_source_mix", "select coalesce(source, 'unknown') as source, count(*) as n from raw_items group by coalesce(source, 'unknown')")
operator("a28_referential_ambiguity", "select thread_key, round(FLOAT(count(distinct case when pr_number_base in ('R3', 'R4') then pr_number_base end)) / greatest(count(distinct pr_number_base), 1), 6) as ambiguity from raw_items group by thread_key")
operator("a29_state_coherence", "select issue_id, case when count(*) > 0 then round(1e0 - FLOAT(count_if(status = 'superseded')) / count(*), 6) end as coherence from claims group by issue_id")
operator("a30_freshness", """
    select thread_key, round(avg(exp(-(:now_events - 864000 - occurred_ts) / 86400e0 / 90e0)), 6) as freshness, round(AT(LIST((:now_events - 864000 - occurred_ts) / 86400e0), cast(IDIV(count(*), 2) as int) + 1), 4) as median_age
    from raw_items where occurred_ts <= :now_events - 864000 group by thread_key""")
operator("a31_context_coverage", "select id, SIZE(FILTER(ARRAY('approve', 'review', 'status'), w, not contains(lower(subject), w))) as n_missing, round(FLOAT(SIZE(FILTER(ARRAY('approve', 'review', 'status'), w, not contains(lower(subject), w)))) / 3e0, 6) as missing_share from raw_items")
operator("a33_confidence_freshness", "select i.id, coalesce(round(avg(exp(-greatest(0e0, :now - c.last_seen_ts) / 86400e0 / 90e0)), 6), 1e0) as freshness from issues i left join claims c on i.id = c.issue_id group by i.id")
operator("a35_provenance", "select issue_id, round(coalesce(avg(case claim_type when 'ask' then 1e0 when 'commitment' then 0.8e0 when 'decision' then 0.4e0 else 0.2e0 end), 1e0), 6) as reliability from claims group by issue_id")
operator("a34_context_accuracy", """
    select id, round((coverage + freshness + provenance + referential) / 4e0, 6) as accuracy from (
      select i.id, coalesce(FLOAT(count(distinct c.claim_type)) / 4e0, 0e0) as coverage, coalesce(avg(exp(-greatest(0e0, :now - c.last_seen_ts) / 86400e0 / 90e0)), 1e0) as freshness,
        coalesce(avg(case c.claim_type when 'ask' then 1e0 when 'commitment' then 0.8e0 when 'decision' then 0.4e0 when 'date' then 0.2e0 end), 1e0) as provenance,
        coalesce(1e0 - FLOAT(count_if(c.reference_base is not null and c.status = 'superseded')) / nullif(count(c.reference_base), 0), 1e0) as referential
      from issues i left join claims c on i.id = c.issue_id group by i.id) x""", deal={"claims": ("issue_id",)})
operator("a32_measure_project", """
    with parts as (select i.project_id, 1e0 - avg(exp(-greatest(0e0, :now - c.first_seen_ts) / 86400e0 / 90e0)) as staleness, FLOAT(count(distinct case when c.status = 'superseded' then c.reference_base end)) / nullif(count(distinct c.reference_base), 0) as ambiguity,
        FLOAT(count_if(c.status = 'superseded')) / count(*) as incoherence, 1e0 - FLOAT(count(distinct c.claim_type)) / 4e0 as missing
      from issues i join claims c on i.id = c.issue_id where c.first_seen_ts <= :now group by i.project_id),
    named as (select project_id, staleness, ambiguity, incoherence, missing, FILTER(ARRAY(case when staleness is null then 'freshness' end, case when ambiguity is null then 'referential' end, case when incoherence is null then 'coherence' end, case when missing is null then 'coverage' end), w, w is not null) as unmeasured from parts)
    select project_id, case when SIZE(unmeasured) < 4 then round((coalesce(staleness, 0e0) + coalesce(ambiguity, 0e0) + coalesce(incoherence, 0e0) + coalesce(missing, 0e0)) / (4e0 - SIZE(unmeasured)), 4) end as ambiguity_score, JOINED(unmeasured, ',') as abstained from named""", deal={"claims": ("issue_id",)})
operator("a36_volatility_population", "select id, case when count(*) >= 3 then round(least(1e0, stddev_pop(score) / 0.25e0), 6) end as volatility from (select id, score, row_number() over (partition by id order by seq desc) as r from scores) x where r <= 5 group by id")
operator("a37_volatility_sample", "select id, round(least(1e0, stddev_samp(score) / 0.25e0), 6) as volatility from (select id, score, row_number() over (partition by id order by seq desc) as r from scores) x where r <= 5 group by id having count(*) >= 2")
operator("a38_project_parties", """
    select relationship_id, affiliation, party_id, n_issues, r = 1 as is_primary from (
      select pr.relationship_id, p.affiliation, p.id as party_id, count(*) as n_issues, row_number() over (partition by pr.relationship_id, p.affiliation order by count(*) desc, p.id) as r
      from projects pr join parties p on p.id = pr.id join issues i on i.project_id = pr.id group by pr.relationship_id, p.affiliation, p.id) x""")
operator("a39_away_summary", """
    select i.project_id, count(distinct case when i.updated_at > :now - 2592000 then i.id end) as touched, count(distinct case when i.state = 'done' and i.updated_at > :now - 2592000 then i.id end) as closed, count(case when c.first_seen_ts > :now - 2592000 then 1 end) as new_claims
    from issues i left join claims c on c.issue_id = i.id group by i.project_id having count(distinct case when i.updated_at > :now - 2592000 then i.id end) > 0""")
operator("a40_status_report", """
    with per_project as (select p.id, p.name, p.relationship_id, count(i.id) as n, count_if(i.state <> 'done') as n_open, max(i.value_amount) as top_value, min(i.due) as next_due from projects p join issues i on i.project_id = p.id group by p.id, p.name, p.relationship_id),
    sizes as (select relationship_id, count(*) as members from per_project group by relationship_id)
    select 'relationship' as kind, TEXT(x.relationship_id) as name, SUMS(x.n) as n, SUMS(x.n_open) as n_open, max(x.top_value) as top_value, min(x.next_due) as next_due from per_project x join sizes s on x.relationship_id = s.relationship_id where s.members >= 2 group by x.relationship_id
    union all select 'project', x.name, x.n, x.n_open, x.top_value, x.next_due from per_project x join sizes s on x.relationship_id = s.relationship_id where s.members < 2""")
operator("a41_relationship_rollup", "select relationship_id, JOINED(SET(category), '; ') as categories, min(name) as first_name, bool_or(status = 'done') as any_done, count(*) as members from projects group by relationship_id")
operator("a42_spend_claim", f"select issue_id, max(v) as amount from (select issue_id, UNNEST({t.dollar_amounts('text')}) as v from claims) x where v >= 10000 group by issue_id")
operator("a43_entity_audit", f"select entity, count(*) as n_spellings, JOINED(SET(name), '|') as spellings, count(distinct domain) as n_domains from (select {t.entity_key('name')} as entity, name, domain from companies) x group by entity having count(distinct name) > 1")
operator("a44_reactions", "select from_actor, thread_key, signal_type, SUMS(case when id % 3 = 0 then -1 else 1 end) as n from raw_items group by from_actor, thread_key, signal_type having sum(case when id % 3 = 0 then -1 else 1 end) > 0")
operator("a45_panel_findings", "select canonical_key, id, JOINED(FILTER(owners, w, w <> owner), ',') as related_owners from (select canonical_key, id, owner, row_number() over (partition by canonical_key order by id) as r from claims) x join (select canonical_key as k2, SET(owner) as owners from claims group by canonical_key) y on x.canonical_key = y.k2 where r = 1")
operator("a46_significance_bar", "select subject, count(*) as n, count(distinct thread_key) as n_threads, round((max(occurred_ts) - min(occurred_ts)) / 86400e0, 4) as span_days from raw_items group by subject having count(*) >= 5 and count(distinct thread_key) >= 2 and max(occurred_ts) - min(occurred_ts) <= 60 * 86400")
operator("a47_labels_with_domain", "select signal_type, JOINED(FIRST_N(SET(TEXT(k)), 3), ',') as samples from raw_items where from_actor like '%firm3%' group by signal_type")
operator("a49_disk_growth", "select day, n, case when n < 0.5e0 * before or n > 2e0 * before then 'odd' else 'sane' end as verdict from (select day, n, lag(n) over (order by day) as before from (select DAY(occurred_at) as day, count(*) as n from raw_items group by 1) x) y")
operator("a50_last_evidence", "select i.id, greatest(max(i.updated_at), coalesce(max(c.last_seen_ts), 0e0)) as last_ts from issues i left join claims c on c.issue_id = i.id group by i.id")
operator("a51_consolidation_groups", f"select organizer, subject_key, hhmm, n_issues, winner from (select from_actor as organizer, {t.normalize_subject('subject')} as subject_key, substr(HHMM(occurred_at), 1, 2) as hhmm, count(distinct issue_id) as n_issues, min_by(issue_id, occurred_ts) as winner from raw_items where source = 'calendar' group by 1, 2, 3) x where n_issues > 1")
operator("a52_calendar_funnel", """
    select stage, count(*) as n from (select case when source is null then 'no_source' when source <> 'calendar' then 'not_calendar' when LIKES(lower(subject), 'out of office') then 'personal' when direction = 'internal' then 'internal' else 'eligible' end as stage from raw_items) x group by stage""")
operator("a52b_calendar_selection", "select id, firm, place from (select id, firm, row_number() over (partition by firm order by occurred_ts desc, id) as place from (select id, occurred_ts, split_part(split_part(from_actor, '@', 2), '.', 2) as firm from raw_items where source = 'calendar' and direction = 'inbound') x) y where place <= 5 order by firm, place limit 30")
operator("a53_inbox_counts", "select owner, count(*) as n from issues where state <> 'done' group by owner")
operator("a54_outcome_summary", "select action_kind, count(*) as n, count_if(outcome = 'accepted') as accepted, round(FLOAT(count_if(outcome = 'accepted')) / count(*), 6) as accepted_rate, round(FLOAT(count_if(outcome = 'accepted' or rewritten)) / count(*), 6) as used_rate from outcomes group by action_kind")
operator("a55_values_for_issues", "select i.id, coalesce(max(c.amount), 0e0) as amount from issues i left join claims c on i.id = c.issue_id and c.claim_type = 'commitment' group by i.id")
operator("a56_content_hashes", "select id, SHA256(chr(123) || '\"owner\":\"' || owner || '\",\"text\":\"' || text || '\",\"type\":\"' || claim_type || '\"' || chr(125)) as content_hash from claims")
operator("a57_handoff_package", "select p.id, p.name, count(distinct i.id) as n_issues, JOINED(MAP_EACH(SET(case when i.state <> 'done' then i.id end), v, TEXT(v)), ',') as open_issues, JOINED(SET(c.owner), ',') as owners, count_if(c.claim_type = 'decision') as n_decisions from projects p join issues i on i.project_id = p.id join claims c on c.issue_id = i.id group by p.id, p.name")
operator("a58_other_portfolio_value", """
    with open_issues as (select i.id, p.company, i.value_amount from issues i join parties p on p.id = i.project_id where i.state <> 'done' and p.company <> ''),
    totals as (select company, sum(value_amount) as amount from open_issues group by company)
    select o.id, round(t.amount - o.value_amount, 2) as other_value from open_issues o join totals t on o.company = t.company""")
operator("a59_unmatched_definitions", "select signal_type, issue_id, max(occurred_ts) as last_ts from raw_items group by signal_type, issue_id having :now_events - max(occurred_ts) > 5 * 86400")
operator("a60_party_indexes", """
    with ranked as (select lower(display_name) as name_key, id, row_number() over (partition by lower(display_name) order by id) as r from parties)
    select name_key, max(r) as n, JOINED(MAP_EACH(LIST(case when r <= 5 then id end), v, TEXT(v)), ',') as ids from ranked group by name_key""")
