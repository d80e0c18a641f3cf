"""Window functions, orderings, limits and top-k."""

from __future__ import annotations

from weftline.functions import text as t
from weftline.plans.registry import operator

SESSIONIZE = operator("w01_sessionize", """
    with gaps as (select id, thread_key, occurred_ts, nullif(pr_number_base, '') as ref, row_number() over (partition by thread_key order by occurred_ts, id) = 1 as is_first,
      coalesce(nullif(pr_number_base, '') is null and occurred_ts - lag(occurred_ts) over (partition by thread_key order by occurred_ts, id) > :gap_hours * 3600, false) as is_gap from raw_items),
    islands as (select *, sum(case when is_gap then 1 else 0 end) over (partition by thread_key order by occurred_ts, id) as g from gaps),
    carried as (select *, LAST_KNOWN(ref) over (partition by thread_key, g order by occurred_ts, id rows between unbounded preceding and 1 preceding) as held from islands),
    reasons as (select *, case when is_first then 'first_message' when is_gap then 'gap_exceeds_' || ':gap_hours' || 'h' when ref is not null and held is not null and ref <> held then 'reference_mismatch' end as reason from carried)
    select id, thread_key, LONG(sum(case when reason is not null and not is_first then 1 else 0 end) over (partition by thread_key order by occurred_ts, id)) as session, reason as boundary_reason from reasons""", gap_hours="72")
_RANKED = f"""
    with urgency as (select issue_id, max(case date_kind when 'hard' then 1e0 when 'soft' then 0.5e0 else 0e0 end) as date_urgency, count(distinct author) as senders, max(amount) as amount,
        round((FLOAT(count(distinct claim_type)) / 4e0 + avg(exp(-greatest(0e0, :now - last_seen_ts) / 86400e0 / 90e0)) + avg(case claim_type when 'ask' then 1e0 when 'commitment' then 0.8e0 when 'decision' then 0.4e0 else 0.2e0 end)) / 3e0, 6) as accuracy from claims group by issue_id),
    scored as (select c.id, c.issue_id, round((0.4e0 * greatest(0e0, {t.staleness_urgency('c.first_seen_ts')}) + 0.3e0 * u.date_urgency + 0.15e0 * {t.value_urgency('u.amount')} + 0.15e0 * case when c.escalated then least(1e0, u.senders / 3e0) else 0e0 end) * u.accuracy, 4) as score
      from claims c join issues i on i.id = c.issue_id join urgency u on u.issue_id = c.issue_id where i.state <> 'done' and c.status = 'open' and c.claim_type in ('ask', 'commitment') and c.owner = :owner),
    top as (select id, issue_id, score, row_number() over (partition by issue_id order by score desc, id) as place from scored)
    select id, issue_id, score from top where place <= 2 order by score desc, id limit :most"""
operator("w02_rank_actions", _RANKED, owner="'user3'", most="50")
operator("w03_uncertainty_trend", "select id, seq, round(greatest(-1e0, least(1e0, score - lag(score) over (partition by id order by seq))), 6) as trend from scores")
operator("w04_trend_state", "select id, seq, case when d is null then 'first' when abs(d) <= 0.02e0 then 'exhausted' when d < 0 then 'improving' else 'conflict' end as state from (select id, seq, round(score - lag(score) over (partition by id order by seq), 6) as d from scores) x")
FORECAST = operator("w05_forecast", """
    with steps as (select id, seq, score, lag(score) over (partition by id order by seq) as before, row_number() over (partition by id order by seq desc) as back from scores where score is not null),
    marked as (select *, round(abs(score - before), 6) <= :deadband as flat, min(case when before is not null and round(abs(score - before), 6) > :deadband then back end) over (partition by id) as moved from steps),
    found as (select id, count(before) as n, max_by(score, seq) as score, max_by(round(score - before, 6), seq) as delta, count(case when flat and (moved is null or back < moved) then 1 end) as flat_run,
        count(case when before > 0 then 1 end) as n_ratios, avg(case when before > 0 then score / before end) as r from marked group by id),
    judged as (select *, case when n = 0 then 'no_history' when delta > :deadband then 'surface_conflict' when flat_run >= 2 then 'spinning' when r is null then 'spend' when r >= 1 and n_ratios >= 2 then 'spinning' else 'spend' end as verdict from found)
    select id, verdict, case when verdict = 'spinning' and flat_run >= 2 then 1e0 when n > 0 and delta <= :deadband then round(r, 3) end as contraction,
      case when n > 0 and delta <= :deadband and flat_run < 2 and r > 0 and r < 1 and score > :target then greatest(1, LONG(ceil(round(ln(:target / score) / ln(r), 6)))) end as passes from judged""", deal={"lineitem": ("l_orderkey",)}, deadband="0.02e0", target="0.15e0")
operator("w06_prune_snapshots", """
    select id, keep from (select id, case when age <= 14 then 'daily' when age <= 70 and row_number() over (partition by LONG(floor(ts / 604800e0)) order by ts desc, id) = 1 then 'weekly' when age <= 430 and row_number() over (partition by MONTH(at_time) order by ts desc, id) = 1 then 'monthly' end as keep
      from (select id, updated_at as ts, updated_time as at_time, (:now - updated_at) / 86400e0 as age from issues) x) y where keep is not null""")
operator("w07_deepdive_candidates", "select id, priority_score, updated_at from issues where state in ('active', 'waiting') order by priority_score asc nulls first, updated_at, id limit 20")
operator("w08_stale_entities", "select i.id, m.seen from issues i left join (select issue_id, max(id) as seen from claims where status = 'done' group by issue_id) m on m.issue_id = i.id where m.seen is null or m.seen % 10 <> i.id % 7 order by m.seen asc nulls first, i.id limit 50")
operator("w09_reply_latency", "select conv_id, count(*) as alternations, round(avg(ts - last_ts), 6) as avg_latency from (select conv_id, ts, direction, lag(direction) over (partition by conv_id order by ts, turn) as last_direction, lag(ts) over (partition by conv_id order by ts, turn) as last_ts from messages where direction <> 'internal') x where direction <> last_direction group by conv_id")
operator("w10_external_companies", "select thread_key, JOINED(SET(case when from_actor not like '%home.example' then split_part(split_part(from_actor, '@', 2), '.', 2) end), ',') as companies_seen from raw_items where source = 'calendar' group by thread_key")
#: The day's focus: the first ranked actions, the meetings of the next day, and every open issue that is due within a week or overdue.
FOCUS = operator("l02_focus_today", f"""
    with actions as ({_RANKED}),
    meetings as (select issue_id, min_by(id, occurred_ts) as id, min(occurred_ts) as next_ts from raw_items where source = 'calendar' and occurred_ts > :now_events - 604800 and occurred_ts <= :now_events - 604800 + :hours * 3600 group by issue_id)
    select 'action' as kind, issue_id, id as item_id, score as measure from actions
    union all select 'meeting', issue_id, id, round((next_ts - (:now_events - 604800)) / 3600e0, 1) from meetings
    union all select 'deliverable', id, id, round((due - :now) / 86400e0, 1) from issues where state <> 'done' and (due - :now) / 86400e0 <= :days""", owner="'user3'", most="8", hours="24", days="7")
operator("l03_renewal_outreach", "select issue_id, first_seen_ts, round((first_seen_ts - :back) / 86400e0, 2) as days_out from claims where claim_type = 'date' and date_kind = 'hard' and (first_seen_ts - :back) / 86400e0 between 30 and 90 order by first_seen_ts, id", back="962668800e0")
operator("l05_candidates_by_project", "select project_id, max_by(id, value_amount * 1000000 - id) as best_id, count(*) as n, JOINED(SET(owner), ',') as owners from issues group by project_id")
operator("l06_open_asks", "select c.id, c.issue_id, c.first_seen_ts from claims c join issues i on i.id = c.issue_id where c.claim_type = 'ask' and c.status = 'open' and i.state <> 'done' order by c.first_seen_ts desc, c.id limit 100")
operator("l07_open_commitments", "select c.id, c.issue_id, c.first_seen_ts from claims c join issues i on i.id = c.issue_id where c.claim_type = 'commitment' and c.status = 'open' and i.state <> 'done' order by c.first_seen_ts desc, c.id limit 100")
operator("l08_key_facts", "select id, trim(w) as fact from (select id, UNNEST(JSON_LIST('[\"fact ' || TEXT(k) || '\", \" \", \"' || signal_type || '\"]')) as w from raw_items) x where trim(w) <> ''")
operator("l09_questions", "select issue_id, 'Who owns ' || claim_type || ' ' || TEXT(id) || '?' as question, place from (select issue_id, claim_type, id, row_number() over (partition by issue_id order by first_seen_ts, id) as place from claims where status = 'open') x where place <= 5")
operator("l10_search_posts", "select id, substr(text, 1, 40) as head from documents_ where contains(lower(text), 'license') order by id desc limit 50")
operator("l11_candidate_actions", """
    with offers as (select issue_id, claim_type as kind, least(0.6e0, 0.3e0 + amount / 500000e0) as score, id from claims where claim_type = 'ask' union all select issue_id, claim_type, 0.5e0, id from claims where claim_type = 'commitment'
      union all select issue_id, claim_type, 0.9e0 - 0.01e0 * (id % 10), id from claims where claim_type = 'decision'),
    firsts as (select *, row_number() over (partition by issue_id, kind order by score desc, id) as r from offers)
    select issue_id, kind, round(score, 9) as score, place from (select *, row_number() over (partition by issue_id order by score desc, kind) as place from firsts where r = 1) x where place <= 4""")
operator("l12_top_projects", "select project_id, min(place) as place from (select project_id, row_number() over (order by value_amount desc, id) as place from (select project_id, value_amount, id from issues where state <> 'done' order by value_amount desc, id limit 200) y) x group by project_id order by place limit 10")
operator("l13_issues_by_priority", "select id, priority_score from issues where state = 'active' order by priority_score desc nulls last, id limit 1000")
operator("l14_review_queue", "select * from (select id, 'Merge ' || title as prompt, opened_at from issues where display_title is not null and state = 'waiting' union all select id, 'Link ' || title, opened_at from issues where has_unmet_prerequisite and state = 'active') x order by opened_at, id, prompt limit 40")
operator("m08_best_lesson", "select action_kind, max_by(id, id % 100 * 1000000 + id) as lesson_id, max(id % 100) as trust from outcomes where outcome = 'accepted' group by action_kind")
operator("m10_learned_order", "select action_kind, row_number() over (order by rate desc, n desc, action_kind) as place from (select action_kind, round(FLOAT(count_if(outcome = 'accepted')) / count(*), 6) as rate, count(*) as n from outcomes group by action_kind) x")
operator("m15_precedent", "select p.id, case when r.n >= 3 and r.rejected >= 0.8e0 then 'rejected' when r.n >= 3 and r.confirmed >= 0.8e0 then 'confirmed' end as precedent from projects p left join (select project_id, count(*) as n, avg(case when state = 'done' then 1e0 else 0e0 end) as confirmed, avg(case when state = 'waiting' then 1e0 else 0e0 end) as rejected from issues group by project_id) r on r.project_id = p.id")
operator("m16_citation", "select r.id, max_by(p.pattern, p.hits) as pattern from (select id, UNNEST(SPLIT(lower(subject), ' ')) as w from raw_items) r join (select lower(w) as pattern, count(*) as hits from (select UNNEST(SPLIT(subject, ' ')) as w from raw_items where id % 3 = 0) x group by lower(w) having count(*) >= 3) p on p.pattern = r.w and p.pattern in ('approve', 'review', 'status') group by r.id")
