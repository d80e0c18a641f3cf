"""Set operations, deduplication, change detection and incremental rules in their batch form."""

from __future__ import annotations

from weftline.functions import text as t
from weftline.plans.registry import operator

operator("d01_dedupe_key", "select id, substr(SHA256(DAY(occurred_at) || '|' || JOINED(SORTED(ARRAY(lower(from_actor), 'user@home.example')), ',') || '|' || lower(trim(coalesce(pr_number_base, '')))), 1, 16) as dedupe_key from raw_items")
operator("d02_canonical_key", f"select id, {t.canonical_key('claim_type', 'text', 'owner', 'reference_base')} as canonical from claims")
operator("d03_merge_duplicates", "select id, issue_id, r = 1 as survives, last_ts from (select id, issue_id, row_number() over (partition by issue_id, claim_type, canonical_key % 20 order by first_seen_ts, id) as r, max(last_seen_ts) over (partition by issue_id, claim_type, canonical_key % 20) as last_ts from claims) x")
operator("d04_extraction_correction", """
    with old_rows as (select issue_id, claim_type, text from claims where id % 3 > 0), new_rows as (select issue_id, claim_type, text from claims where id % 3 < 2),
    change as (select coalesce(o.issue_id, n.issue_id) as issue_id, coalesce(o.claim_type, n.claim_type) as claim_type, o.text as old_text, n.text as new_text from (select distinct * from old_rows) o full outer join (select distinct * from new_rows) n on o.issue_id = n.issue_id and o.claim_type = n.claim_type and o.text = n.text where o.text is null or n.text is null)
    select issue_id, claim_type, count(old_text) as superseded, count(new_text) as added, case when count(old_text) = 1 and count(new_text) = 1 then 'refine' else 'replace' end as action from change group by issue_id, claim_type""", deal={"claims": ("issue_id", "claim_type", "text")})
operator("d06_relationship_sweep", f"select name, min(id) as id, count(*) as n_links from (select {t.normalize_company_name('name')} as name, id from companies) x where not exists (select 1 from projects p where lower(p.name) = x.name) group by name")
operator("d07_seeds", "select distinct project_id, 'owner' as kind, owner as value from issues union select distinct project_id, 'category', category from issues")
operator("d08_alerts", """
    with activity as (select i.id, i.state, greatest(coalesce(max(c.last_seen_ts), i.updated_at), coalesce(max(s.changed_ts), i.updated_at)) as last_ts from issues i left join claims c on c.issue_id = i.id left join states s on s.issue_id = i.id where i.state in ('waiting', 'blocked') group by i.id, i.state, i.updated_at),
    refs as (select l.reference, i.id, i.project_id from links l join issues i on l.issue_id = i.id where i.state <> 'done'),
    figures as (select c.issue_id from claims c join issues i on i.id = c.issue_id where i.state <> 'done' and c.claim_type = 'commitment' group by c.issue_id having count(distinct c.amount) >= 2),
    asks as (select i.project_id, c.claim_type, c.canonical_key, min(c.issue_id) as issue_id, count(distinct c.text) as texts from claims c join issues i on c.issue_id = i.id where c.status = 'open' group by i.project_id, c.claim_type, c.canonical_key having count(distinct c.issue_id) >= 2),
    found as (select id as issue_id, 'stale' as kind, '' as source_ref, case when :now - last_ts >= :critical_days * 86400 then 'critical' else 'warn' end as severity from activity where :now - last_ts >= :warn_days * 86400
      union all select issue_id, 'high_priority_ask', TEXT(id), 'warn' from claims where claim_type = 'ask' and status = 'open' and escalated
      union all select issue_id, 'stuck_action', TEXT(id), 'critical' from actions where status <> 'done' and :now_events - requested_ts >= :stuck_minutes * 60
      union all select id, 'unmet_prerequisite', '', 'warn' from issues where state <> 'done' and has_unmet_prerequisite
      union all select a.id, 'reference_id_collision', TEXT(a.id) || '|' || TEXT(b.id), 'warn' from refs a join refs b on a.reference = b.reference and a.id < b.id and a.project_id <> b.project_id group by a.id, b.id
      union all select issue_id, 'conflicting_value_figures', '', 'warn' from figures
      union all select issue_id, 'duplicate_ask_across_project', claim_type || ':' || TEXT(canonical_key), case when texts > 1 then 'warn' else 'info' end from asks),
    shown as (select id as issue_id, 'unmet_prerequisite' as kind, '' as source_ref from issues where id % 5 = 0 union all select issue_id, 'stuck_action', TEXT(id) from actions where id % 7 = 0)
    select f.issue_id, f.kind, f.source_ref, f.severity from found f where not exists (select 1 from shown s where s.source_ref <> '' and s.kind = f.kind and s.source_ref = f.source_ref) and not exists (select 1 from shown s where s.source_ref = '' and s.kind = f.kind and s.issue_id = f.issue_id)""", deal={"claims": ("issue_id",)}, warn_days="5", critical_days="12", stuck_minutes="30")
operator("d09_self_audit", """
    with now_found as (
      select distinct 'closed_with_open_claims' as detector, c.issue_id from claims c join issues i on i.id = c.issue_id where i.state = 'done' and c.status = 'open'
      union all select 'resolved_but_open', i.id from issues i join claims c on c.issue_id = i.id where i.state in ('active', 'waiting') group by i.id having count_if(c.status = 'open') = 0
      union all select distinct 'contradictory_owners', issue_id from (select issue_id from claims where status = 'open' group by issue_id, claim_type, canonical_key having count(distinct owner) >= 2) a
      union all select 'duplicate_asks', min(c.issue_id) from claims c join issues i on i.id = c.issue_id where c.status = 'open' group by i.project_id, c.claim_type, c.canonical_key having count(distinct c.issue_id) >= 2
      union all select 'stale_active', i.project_id from issues i join projects p on p.id = i.project_id where p.status = 'active' group by i.project_id having max(i.updated_at) < :now - 30 * 86400
      union all select distinct 'done_with_commitments', i.project_id from projects p join issues i on i.project_id = p.id join claims c on c.issue_id = i.id where p.status = 'done' and c.claim_type = 'commitment' and c.status = 'open'),
    before as (select 'closed_with_open_claims' as detector, id as issue_id from issues where state = 'done' and id % 2 = 0), fresh as (select distinct detector, issue_id from now_found)
    select coalesce(b.detector, n.detector) as detector, coalesce(b.issue_id, n.issue_id) as issue_id, case when b.issue_id is null then 'new' when n.issue_id is null then 'resolved' else 'kept' end as status
    from before b full outer join fresh n on b.issue_id = n.issue_id and b.detector = n.detector""", deal={"claims": ("issue_id",)})
operator("d10_identity_anchors", "select value, issue_id, r = 1 as owns from (select reference as value, issue_id, row_number() over (partition by reference order by issue_id) as r from links) x")
operator("d12_stray_reference_clusters", "select reference, min(case when issue_id % 3 > 0 then issue_id end) as real_issue, count_if(issue_id % 3 = 0) as n_clusters from links group by reference having count_if(issue_id % 3 > 0) = 1 and count_if(issue_id % 3 = 0) >= 1")
operator("d13_timeline", "select issue_id, ts, kind, tier, id from (select issue_id, first_seen_ts as ts, 'claim' as kind, case claim_type when 'decision' then 'milestone' else 'activity' end as tier, id from claims union all select id, updated_at, 'state', 'milestone', id from issues) x")
operator("d14_project_link_signals", "select distinct a.project_id as from_id, b.project_id as to_id from issues a join issues b on b.id = a.id + 1 join projects p on p.id = b.project_id where a.project_id <> b.project_id and not exists (select 1 from issues e where e.project_id = a.project_id and e.id = b.id + 6)")
operator("g05_dormant_sweep", "select i.id, i.state, case when greatest(i.updated_at, coalesce(max(c.last_seen_ts), 0e0)) < :now - 60 * 86400 then 'dormant' else i.state end as new_state from issues i left join claims c on c.issue_id = i.id where i.state in ('active', 'waiting') group by i.id, i.state, i.updated_at")
operator("g06_revert_dormant", "select i.id from issues i join claims c on c.issue_id = i.id where i.state = 'waiting' and i.updated_at < :now - 60 * 86400 group by i.id, i.updated_at having max(c.last_seen_ts) > i.updated_at + 100 * 86400")
operator("g07_recompute_state", """
    select x.issue_id, case when x.manual_closed and not x.new_actionable then 'done' when x.actionable then 'active' when x.waiting then 'waiting' else 'done' end as state
    from (select issue_id, bool_or(item_class = 'ACTIONABLE-ASK') as actionable, bool_or(item_class = 'WAITING-ON-OTHERS') as waiting, issue_id % 4 = 0 as manual_closed, bool_or(item_class = 'ACTIONABLE-ASK' and occurred_ts > :now_events - 86400) as new_actionable from raw_items group by issue_id) x""")
operator("g08_target_state", """
    with kinds as (select distinct issue_id, signal_type from raw_items),
    unanswered as (select distinct k.issue_id from kinds k join closures c on k.signal_type = c.request_type where not exists (select 1 from kinds q where q.issue_id = k.issue_id and q.signal_type = c.closure_type))
    select r.issue_id, case when bool_or(r.item_class = 'ACTIONABLE-ASK') then 'active' when bool_or(r.item_class = 'WAITING-ON-OTHERS') then 'waiting' when bool_or(u.issue_id is not null) then 'active' else 'done' end as state
    from raw_items r left join unanswered u on u.issue_id = r.issue_id group by r.issue_id""")
operator("g03_observations", f"select {t.sender_domain('from_actor')} as domain, count(*) as n, count(distinct thread_key) as n_threads, min(occurred_ts) as first_ts, max(occurred_ts) as last_ts from raw_items group by 1")
operator("g10_cursor_lag", "select source, max(occurred_ts) as cursor_ts, :now_events - max(occurred_ts) > 48 * 3600 as lagging from raw_items where source is not null group by source")
operator("g11_needing_extraction", "select i.project_id, max(c.id) as rev, min(i.id) as marker from issues i join claims c on c.issue_id = i.id group by i.project_id having max(c.id) % 7 <> min(i.id) % 7 order by i.project_id limit 100")
operator("g12_freshness_status", "select round((:now_events - max(occurred_ts)) / 3600e0, 4) as lag_hours, case when :now_events - max(occurred_ts) > 86400 then 'stale' else 'fresh' end as status from raw_items")
operator("g14_retention", "select case when occurred_ts < :now_events - 20 * 86400 then 'archive' else 'keep' end as policy, count(*) as n from raw_items group by 1")
operator("s03_calendar_rows", "select id, case when k % 3 = 0 then TEXT(issue_id) || ':' || DAY(occurred_at) else TEXT(issue_id) end as stable_key, lower(from_actor) as organizer, subject from raw_items where source = 'calendar'")
operator("s05_document_rows", "select id, 'drive' || TEXT(id % 4) || ':' || TEXT(id) as stable_key, length(text) as size from documents_")
operator("s11_unambiguous_paths", "select w.id, f.path from (select id, 'file' || TEXT(id % 300) || '.docx' as filename from raw_items) w left join (select lower('File' || TEXT(id % 400) || '.docx') as filename, min('/share/' || TEXT(id)) as path from documents_ group by 1 having count(*) = 1) f on w.filename = f.filename")
operator("s14_item_text", f"select id, coalesce(nullif({t.strip_quoted_reply('body_preview')}, ''), nullif(trim(REPLACE_ALL(subject, '<[^>]*>', ' ')), ''), '') as text from raw_items")
operator("s15_best_link", """
    select id, coalesce(AT(FILTER(links_found, w, contains(w, '/the')), 1), AT(links_found, 1)) as link from (select id, EXTRACT_ALL(lower(html), '<a href="([^"]*)"', 1) as links_found from pages_) x""")
operator("s16_document_links", """select id, w as link from (select id, UNNEST(EXTRACT_ALL(html, '<a href="([^"]*)"', 1)) as w from pages_) x where LIKES(w, '^/[Tt]h')""")
operator("s19_issues_export", "select id, title, category, state, value_amount, updated_at from issues where updated_at between :now - 400 * 86400 and :now order by updated_at, id")
