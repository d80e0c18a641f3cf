"""Projections, predicates and scalar functions."""

from __future__ import annotations

from weftline.functions import text as t
from weftline.plans.registry import operator


def scalar(name: str, expression: str, view: str, key: str = "id", more: str = ""):
    return operator(name, f"select {key}, {expression} as result{more} from {view}")


# text
scalar("f01_normalize_company_name", t.normalize_company_name("name"), "companies")
scalar("f02_entity_key", t.entity_key("name"), "companies")
scalar("f03_reference_base", t.reference_base("subject"), "raw_items")
operator("f04_classify_signal", f"""
    select id, {t.classify_signal("subject", "from_actor")} as result, {t.signal_treatment("subject", "from_actor", "'PR' || TEXT(k)", ("status_request",))} as treatment,
      nullif(regexp_extract(upper(subject), '(PR[0-9]+(-V[0-9]+)?)', 1), '') as pr_number from raw_items""")
scalar("f06_normalize_subject", t.normalize_subject("subject"), "raw_items")
scalar("f07_conservative_normalize", t.conservative_normalize("body_preview"), "raw_items")
scalar("f08_sender_domain", t.sender_domain("from_actor"), "raw_items")
scalar("f09_company_from_domain", t.company_from_domain("domain"), "companies")
scalar("f10_classify_affiliation", t.classify_affiliation("primary_email"), "parties")
scalar("f15_strip_quoted_reply", t.strip_quoted_reply("body_preview"), "raw_items")
scalar("f16_situation_signature", t.situation_signature("body_preview"), "raw_items")
scalar("f17_filename_core_tokens", f"JOINED({t.filename_core_tokens('title')}, ' ')", "issues")
scalar("f18_dollar_amounts", f"JOINED(MAP_EACH({t.dollar_amounts('body_preview')}, v, TEXT(LONG(v))), ',')", "raw_items")
scalar("f22_action_family", t.action_family("subject"), "raw_items")
scalar("f23_situation_key", t.situation_key("category", "name"), "projects")
scalar("f24_strip_subject_prefix", t.strip_subject_prefix("subject"), "raw_items")
scalar("f25_tag_issue_id", "nullif(regexp_extract(title, 'Order ([0-9]+)', 1), '')", "issues")
scalar("f26_text_matches_any", "ANY_OF(ARRAY('signed copy', 'urgent', 'completed'), p, contains(lower(body_preview), p))", "raw_items")
scalar("f29_estimate_tokens", t.estimate_tokens("text"), "documents_")
scalar("f31_strip_leading_mention", "trim(REPLACE_ALL('@' || owner || ' ' || title, '^@[^ ]+ +', ''))", "issues")
scalar("f21_audit_time_claims", "case when LIKES(lower(body_preview), '(friday|tomorrow|by the date)') then body_preview || ' [server time ' || TEXT(WHOLE(occurred_ts)) || ']' else body_preview end", "raw_items")
operator("f05_classify_item", f"""
    select id, item_class, direction, topic, sentiment,
      case when inferred <= 1 then 'H' when inferred = 2 then 'M' else 'L' end as confidence
    from (
      select id,
        case when LIKES(s, 'out of office') then 'NOISE' when signal in ('approval_request', 'review_request', 'portal_approval') then 'ACTIONABLE-ASK'
          when signal = 'approval_complete' then 'WAITING-ON-OTHERS' when LIKES(b, 'fyi only') then 'NOISE' when LIKES(b, '(can you|please send|urgent)') then 'ACTIONABLE-ASK'
          when LIKES(b, '(completed|all good)') then 'WAITING-ON-OTHERS' else 'FYI-EVIDENCE' end as item_class,
        case when direction = 'internal' then 'internal' when domain = 'home.example' then 'outbound' else 'inbound' end as direction,
        case when LIKES(s, '(invoice|approve)') then 'finance' when LIKES(s, 'meeting') then 'meeting' else 'general' end as topic,
        case when LIKES(b, '(thanks|all good)') and not LIKES(b, '(urgent|late|blocked)') then 'positive' when LIKES(b, '(urgent|late|blocked)') and not LIKES(b, '(thanks|all good)') then 'negative' else 'neutral' end as sentiment,
        case when signal is null then 1 else 0 end + case when source is null then 1 else 0 end + case when LIKES(b, '(thanks|urgent)') then 0 else 1 end as inferred
      from (select id, source, direction, lower(subject) as s, lower(body_preview) as b, {t.classify_signal('subject', 'from_actor')} as signal, {t.sender_domain('from_actor')} as domain from raw_items) x
    ) y""")
operator("f11_requisition_fields", """
    select id, nullif(regexp_extract(subject, 'PR([0-9]+)', 1), '') as pr_number, nullif(regexp_extract(subject, 'PR[0-9]+-V([0-9]+)', 1), '') as version,
      nullif(regexp_extract(subject, '(Approve|review|Status of) ', 1), '') as action, nullif(regexp_extract(subject, '([a-z]+) PR[0-9]', 1), '') as item from raw_items""")
operator("f12_labelled_fields", """
    select id, nullif(trim(regexp_extract(body_preview, 'Owner: ([^' || chr(10) || ']*)', 1)), '') as owner,
      nullif(trim(regexp_extract(body_preview, 'Due Date: ([^' || chr(10) || ']*)', 1)), '') as due_date,
      nullif(trim(regexp_extract(body_preview, 'Vendor: ([^' || chr(10) || ']*)', 1)), '') as vendor from raw_items""")
operator("f14_pattern_signatures", f"""
    select id, JOINED(UNIQUE(FILTER(EXTRACT_ALL(chr(10) || body_preview, chr(10) || '([A-Z][A-Za-z ]+):', 1), w, not CONTAINS(ARRAY('From', 'Sent', 'To'), w))), '|') as labels,
      {t.sender_domain('from_actor')} as domain from raw_items""")
MEMBERS = {"ab": "builder", "cb": "curator", "rl": "relay"}
_SEEN = ", ".join(f"{t.intent_around('body', patterns, 'manager', MEMBERS)} as around_{n}" for n, (_, _, patterns) in enumerate(t.INTENTS))


def _by_intent(values) -> str:
    return f"case n {' '.join(f'when {n} then {v}' for n, v in enumerate(values))} end"


#: One row for each intent of a message; a question counts only where it addresses a member.
INTENTS = operator("f20_message_intents", f"""
    with seen as (select id, {t.target_member('body', 'actor', MEMBERS)} as target, {_SEEN} from (select * from ({{MESSAGES}}) w where length(REPLACE_ALL(body, RAW('^\\s+|\\s+$'), '')) >= 3) m),
    each_kind as (select *, UNNEST(SPAN(0, {len(t.INTENTS) - 1})) as n from seen),
    found as (select id, n, {_by_intent(f"'{kind}'" for kind, _, _ in t.INTENTS)} as kind, {_by_intent(["'manager'", "target", "target", "target", "cast(null as string)", "cast(null as string)"])} as target,
      {_by_intent(c for _, c, _ in t.INTENTS)} as confidence, {_by_intent(f"around_{n}" for n in range(len(t.INTENTS)))} as snippet, target as addressed from each_kind)
    select id, kind, target, confidence, snippet from found where snippet is not null and (kind <> 'asking_question' or addressed is not null)""".replace("{MESSAGES}", """
      select id, case id % 3 when 0 then 'builder' when 1 then 'relay' end as actor, case id % 8 when 0 then '@ab ' || body_preview when 1 then 'CB, please take this. ' || body_preview when 2 then 'We are blocked on the invoice, ask rl. ' || body_preview
        when 3 then 'Proposal: escalate to manager. ' || body_preview when 4 then 'Shipped the report to them.' when 5 then ' x' when 6 then subject || chr(10) || 'For AB - can''t proceed' || chr(10) || body_preview || ' ' || body_preview || ' needs manager approval' else body_preview end as body from raw_items""".strip()))
operator("f27_depth", """
    select id, case greatest(case when LIKES(lower(body_preview), '(urgent|blocked)') then 3 when contains(body_preview, '?') then 2 else 1 end, case when amount > 50 then 2 else 0 end, case when item_class = 'ACTIONABLE-ASK' then 2 else 0 end)
      when 1 then 'glance' when 2 then 'standard' else 'deep' end as depth from raw_items""")
operator("f28_recommendations", f"""
    select id, JOINED(FILTER(ARRAY(case when item_class = 'ACTIONABLE-ASK' and direction = 'inbound' then 'reply' end, case when item_class = 'WAITING-ON-OTHERS' and :now_events - occurred_ts > 604800 then 'nudge' end,
      case when signal in ('approval_request', 'portal_approval') then 'approve' end, case when signal = 'meeting' then 'prepare' end), w, w is not null), ',') as actions
    from (select id, item_class, direction, occurred_ts, {t.classify_signal('subject', 'from_actor')} as signal from raw_items) x""")
operator("f30_match_signal_type", """
    with types as (select * from (values (1, 'signup'), (2, 'click'), (3, 'view'), (4, 'error'), (5, 'purchase')) as v(n, name)),
    asked as (select id, case id % 6 when 0 then TEXT(id % 7) when 1 then upper(signal_type) when 2 then substr(signal_type, 2, 3) else 'i' end as answer from raw_items),
    exact as (select a.id, min(name) as name from asked a join types on LIKES(answer, '^[0-9]+$') and TOLONG(answer) = n or lower(answer) = name group by a.id),
    partly as (select a.id, min(name) as name from asked a join types on contains(name, lower(answer)) and not LIKES(answer, '^[0-9]+$') group by a.id having count(*) = 1)
    select a.id, a.answer, coalesce(exact.name, partly.name) as matched from asked a left join exact on a.id = exact.id left join partly on a.id = partly.id""")

# time
scalar("t01_parse_iso", "coalesce(EPOCH_ISO(case when id % 4 = 0 then 'not a date' else TEXT(occurred_at) end), :now_events)", "raw_items")
scalar("t02_parse_due", "EPOCH_ISO(case when id % 5 = 0 then 'soon' else DAY(updated_time) || ' 10:30:00' end)", "issues")
scalar("t04_due_urgency", f"round({t.due_urgency('due')}, 6)", "issues")
scalar("t05_staleness_urgency", f"round({t.staleness_urgency('updated_at')}, 6)", "issues")
operator("t06_last_month_keys", "select MONTH(m) as month_key from (select UNNEST(MONTHS(cast('2024-01-31' as timestamp), 12)) as m) x")
scalar("t07_calendar_series_key", "case when id % 3 = 0 then 'series:' || TEXT(k) when from_actor is not null then lower(from_actor) || '|' || lower(subject) || '|' || HHMM(occurred_at) else TEXT(id) end", "raw_items")
operator("t03_deadline_info", """
    select i.id, coalesce(case when i.id % 3 > 0 then i.due end, c.next_ts) as due_ts, round((coalesce(case when i.id % 3 > 0 then i.due end, c.next_ts) - :now) / 86400e0, 4) as days_out,
      coalesce(case when i.id % 3 > 0 then i.due end, c.next_ts) < :now as overdue, coalesce(c.hard, false) as hard
    from issues i left join (select issue_id, min(case when first_seen_ts between :now and :now + 1209600 then first_seen_ts end) as next_ts, bool_or(date_kind = 'hard') as hard from claims where claim_type = 'date' group by issue_id) c on i.id = c.issue_id
    where i.state <> 'done'""")
operator("t08_away_window", "select count(*) as n_items, count(distinct issue_id) as n_threads from raw_items where occurred_ts > :now_events - 72 * 3600 and occurred_ts <= :now_events")

# scores
scalar("m03_value_urgency", f"round({t.value_urgency('value_amount')}, 6)", "issues")
scalar("m05_snooze_boost", "round(least(1e0, coalesce(priority_score, 0e0) + 0.05e0 * least(LONG(id % 8), 5)), 6)", "issues")
scalar("m06_ask_density_boost", "round(least(1e0, coalesce(priority_score, 0e0) + 0.04e0 * least(greatest(0, LONG(id % 9) - 1), 5)), 6)", "issues")
scalar("m07_precedent_boost", "round(least(1e0, coalesce(priority_score, 0e0) + 0.1e0 * case when id % 3 = 0 then 0.9e0 else 0e0 end), 6)", "issues")
operator("m09_confidence_band", "select id, seq, case when score >= :high then 'high' when score >= :least then 'medium' else 'low' end as result from scores", high="0.8e0", least="0.6e0")
scalar("m12_referential_resolution", "round(1e0 - least(1e0, greatest(0e0, FLOAT(k % 7) / greatest(k % 11, 1))), 6)", "raw_items")
scalar("m13_context_coverage", "round(FLOAT(SIZE(SHARED(SPLIT(subject, ' '), ARRAY('Approve', 'review', 'Status')))) / 3e0, 6)", "raw_items")
scalar("p12_effective_score", "round(score * 0.85e0, 6)", "scores", key="id, seq")
operator("m04_date_urgency", "select issue_id, max(case date_kind when 'hard' then 1e0 when 'soft' then 0.5e0 else 0e0 end) as urgency from claims group by issue_id")
operator("m02_score_claim", f"""
    select id, issue_id, round(0.4e0 * greatest(0e0, {t.staleness_urgency('first_seen_ts')}) + 0.3e0 * case date_kind when 'hard' then 1e0 when 'soft' then 0.5e0 else 0e0 end
      + 0.15e0 * {t.value_urgency('amount')} + 0.15e0 * case when escalated then least(1e0, 1e0 / 3e0) else 0e0 end, 4) as score from claims where claim_type in ('ask', 'commitment')""")
operator("m01_score_issue", f"""
    with baselines as (select category, greatest(3e0, round(MEDIAN(gap), 6)) as days from (select category, (updated_at - lag(updated_at) over (partition by category, project_id order by updated_at, id)) / 86400e0 as gap from issues) g where gap > 0 group by category having count(*) >= 8),
    evidence as (select issue_id, count_if(claim_type = 'ask' and status = 'open') as asks, round(avg(exp(-greatest(0e0, :now - last_seen_ts) / 86400e0 / 90e0)), 6) as freshness, bool_or(reference_base is not null) as referenced from claims group by issue_id),
    backed as (select distinct i.id as issue_id from issues i join claims c on c.issue_id = i.id and c.claim_type = 'decision' where round(c.amount / 1000e0, 0) = round(i.value_amount / 1000e0, 0)),
    snoozed as (select issue_id, count(*) as n, max(changed_ts) as last_ts from states where to_state = 'waiting' and actor is not null group by issue_id),
    parts as (
      select i.id, i.state, i.has_unmet_prerequisite, i.value_amount, coalesce(c.asks, 0) as asks, coalesce(s.n, 0) as snoozes, s.last_ts, b.issue_id is not null as corroborated, {t.due_urgency('i.due')} as due_urgency,
        LONG(floor(greatest(0e0, :now - i.updated_at) / 86400e0)) as quiet,
        round((case when i.category is null or i.category = 'other' then 0e0 else 0.5e0 end + case when c.issue_id is null then 0e0 else 0.5e0 end + coalesce(c.freshness, 1e0)
          + case when c.referenced then 1e0 else 0.15e0 end + case when c.referenced then 1e0 else 0e0 end) / 4e0, 6) as accuracy,
        0.45e0 * case i.state when 'active' then 1e0 when 'blocked' then 0.3e0 else 0e0 end + 0.25e0 * least(1e0, greatest(0e0, :now - i.updated_at) / 86400e0 / coalesce(l.days, 14e0)) + 0.12e0 * {t.due_urgency('i.due')} + 0.18e0 * {t.value_urgency('i.value_amount')} as base
      from issues i left join evidence c on i.id = c.issue_id left join snoozed s on i.id = s.issue_id left join backed b on i.id = b.issue_id left join baselines l on l.category = i.category),
    scored as (select *, least(1e0, least(1e0, round(base * accuracy, 6) + 0.05e0 * least(snoozes, 5)) + 0.04e0 * least(greatest(0, asks - 1), 5)) as boosted from parts)
    select id, case when state = 'done' then 0e0 else FLOAT(round(cast(case when has_unmet_prerequisite then 0.6e0 else 1e0 end * case when corroborated then least(1e0, boosted + 0.05e0) else boosted end as decimal(18, 8)), 4)) end as score,
      case when state = 'done' then 'closed' when reasons = '' then 'waiting on someone else' else reasons end as reason
    from (select *, concat_ws(' · ', case when has_unmet_prerequisite then 'prerequisite not met' end, case state when 'active' then 'your move' when 'blocked' then 'blocked but stuck' end,
        case when quiet >= 7 then 'quiet ' || TEXT(quiet) || 'd' end, case when due_urgency > 0.9e0 then 'overdue' when due_urgency > 0.3e0 then 'due soon' end,
        case when value_amount >= 1000000 then '$' || TEXT(LONG(floor(value_amount / 100000e0)) / 10e0) || 'M' when value_amount >= 1000 then '$' || THOUSANDS(value_amount) end,
        case when corroborated then 'value confirmed by attachment' end, case when snoozes >= 2 then 'snoozed ' || TEXT(snoozes) || 'x, last ' || TEXT(LONG(floor((:now - last_ts) / 86400e0))) || 'd ago' end,
        case when asks >= 3 then TEXT(asks) || ' open asks' end) as reasons from scored) x""")

# projections and predicates
operator("p01_slim", "select id, coalesce(display_title, title) as title, state, category from issues")
operator("p02_query_events", "select id, occurred_ts, signal_type, from_actor, k from raw_items where occurred_ts > :now_events - 864000 and signal_type like 'p%' and direction = 'inbound' order by id desc limit 50")
operator("p03_parties_needing_review", "select id, primary_email from parties where affiliation = 'external' and company = ''")
operator("p04_meeting_prep", "select issue_id, min(occurred_ts) as next_ts, round((min(occurred_ts) - (:now_events - 604800)) / 3600e0, 1) as hours_out, min_by(id, occurred_ts) as item_id from raw_items where source = 'calendar' and occurred_ts > :now_events - 604800 and occurred_ts <= :now_events - 604800 + 48 * 3600 group by issue_id")
operator("p05_snooze_history", "select issue_id, changed_ts, actor from states where to_state = 'waiting' and actor is not null")
operator("p06_closed_and_stale", "select id, state = 'done' and updated_at < :now - 365 * 86400 as closed_and_stale from issues")
operator("p07_project_noise", f"""
    select i.issue_id, bool_and(coalesce(i.domain, '') in (:noise_domains)) and count(i.pr_number_base) = 0 and not bool_or(i.money) as noise
    from (select issue_id, {t.sender_domain('from_actor')} as domain, pr_number_base, LIKES(body_preview, '[$][0-9]') as money from raw_items) i group by i.issue_id""", noise_domains="'mail.firm1.example', 'mail.firm2.example', 'home.example', 'mail.firm5.example'")
operator("p08_repeat_signals", "select id, issue_id, round((last_seen_ts - first_seen_ts) / 86400e0, 2) as days_between from claims where last_seen_ts > first_seen_ts order by days_between desc, id")
operator("p09_fyi_real_signal", "select id, pr_number_base is not null or LIKES(from_actor, 'firm[0-3]') or contains(subject, 'PR') or contains(body_preview, '/sites/') as real_signal from raw_items where item_class = 'FYI-EVIDENCE'")
operator("p10_personal_block", "select id, SIZE(FILTER(ARRAY(lower(from_actor), case when id % 2 = 0 then lower(from_actor) else 'guest@x.example' end), w, w <> lower(from_actor))) = 0 as personal from raw_items where source = 'calendar'")
operator("p11_domain_matches", "select id, domain = 'mail.firm-3.com' or domain like '%.firm-3.com' as matches from companies")
operator("p13_patterns", "select id, JOINED(FILTER(ARRAY(case when contains(lower(text), 'send') then 'send' end, case when LIKES(text, '[$][0-9]+k') then 'money' end, case when LIKES(text, 'part [0-9][0-9]') then 'part' end), w, w is not null), ',') as keys from claims")
operator("p14_paragraphs", "select id, SIZE(FILTER(MAP_EACH(SPLIT(text, chr(10)), p, trim(p)), w, w <> '')) as n_paragraphs, AT(FILTER(MAP_EACH(SPLIT(text, chr(10)), p, trim(p)), w, w <> ''), 1) as first_paragraph from documents_")
operator("p15_topic_key", "select id, case when id % 3 = 0 and length(lower(title)) >= 15 then lower(title) end as topic_key from issues")
operator("p16_domain_seen_on_issue", f"""
    with items as (select id, issue_id, {t.sender_domain('from_actor')} as domain from raw_items), firsts as (select issue_id, domain, min(id) as id from items where domain is not null group by issue_id, domain)
    select a.id, coalesce(f.id < a.id, false) as seen from items a left join firsts f on f.issue_id = a.issue_id and f.domain = a.domain""")
operator("p17_proactive_action", "select id, case when direction <> 'inbound' then null when k % 4 = 0 and contains(subject, 'review') then 'redline' when contains(subject, 'Status') then 'status_reply' end as action from raw_items")
# arrays, JSON, parsing
operator("n03_work_object_signature", "select i.project_id, JOINED(SET(i.category), ',') as categories, JOINED(SET(i.owner), ',') as owners, count(distinct i.id) as n_issues, max(i.value_amount) as top_value from issues i group by i.project_id")
operator("n04_index_values", "select 'reference' as definition, reference as value, issue_id as id from links union all select 'owner', owner, id from issues where state = 'waiting'")
operator("n05_participants", "select id, SIZE(JSON_LIST('[\"' || from_actor || '\", \"' || signal_type || '\"]')) as n, AT(JSON_LIST('[\"' || from_actor || '\", \"' || signal_type || '\"]'), 1) as first_participant from raw_items")
operator("n06_value_for_signature", "select id, case when contains(body_preview, 'Owner:') then trim(regexp_extract(body_preview, 'Owner: ([^' || chr(10) || ']*)', 1)) end as value from raw_items")
operator("u02_comparative_verdict", """
    select id, case when choice between 1 and 5 then choice end as choice, case when verdict in ('SAME', 'DIFFERENT') then verdict else 'INVALID' end as verdict
    from (select id, TOLONG(nullif(regexp_extract(reply, 'MATCH: *([0-9]+)', 1), '')) as choice, regexp_extract(reply, 'VERDICT: *([A-Z]+)', 1) as verdict
      from (select id, 'MATCH: ' || TEXT(k % 8) || chr(10) || 'VERDICT: ' || case k % 3 when 0 then 'SAME' when 1 then 'DIFFERENT' else 'UNSURE' end as reply from raw_items) x) y""")
operator("u04_parse_proposal", "select id, nullif(trim(regexp_extract(reply, 'NAME: ([^' || chr(10) || ']*)', 1)), '') as name, nullif(trim(regexp_extract(reply, 'TYPE: ([a-z]*)', 1)), '') as point_type from (select id, 'NAME: field ' || TEXT(k) || chr(10) || 'TYPE: ' || case k % 2 when 0 then 'amount' else '' end as reply from raw_items) x")
operator("g13_known_signal_types", "select rule_id, requires_type as signal_type from rules union all select rule_id, trigger_type from rules")
