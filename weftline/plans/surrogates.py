"""The work graph's tables as deterministic views over the driver's tables.

The driver's data has no mail, so orders stand for issues, line items for claims and evidence, customers for
projects and parties, events for raw items. Each view is written once and built alike in Spark and in DuckDB.
"""

from __future__ import annotations

import re

NOW = "996710400e0"  # 2001-08-02, the day after the last order
NOW_EVENTS = "1706659200e0"  # 2024-01-31

VIEWS = {
    "raw_items": """
        select event_id as id, TEXT(user_id) as thread_key, EPOCH(ts) as occurred_ts, ts as occurred_at, event_type as signal_type, value as amount,
          cast(JSON(props, 'k') as int) as k, user_id as issue_id,
          case when event_type = 'purchase' then 'R' || TEXT(cast(JSON(props, 'k') as int) % 5) end as pr_number_base,
          case event_id % 4 when 0 then 'outlook_mail' when 1 then 'teams_chat' when 2 then 'calendar' end as source,
          case when event_id % 3 = 0 then 'outbound' when event_id % 11 = 5 then 'internal' else 'inbound' end as direction,
          case event_type when 'error' then 'ACTIONABLE-ASK' when 'purchase' then 'WAITING-ON-OTHERS' when 'view' then 'NOISE' else 'FYI-EVIDENCE' end as item_class,
          'user' || TEXT(event_id % 23) || '@' || case when event_id % 3 = 0 then 'home.example' else 'mail.firm' || TEXT(event_id % 7) || '.example' end as from_actor,
          case event_id % 6 when 0 then 'Re: FW: Status of ' when 1 then 'Meeting: ' when 2 then 'RE: re: Please review ' when 3 then 'Out of office: ' when 4 then 'Invoice approved for ' else 'Action required: Approve ' end
            || event_type || ' PR' || TEXT(event_id % 50) || case when event_id % 5 = 0 then '-V' || TEXT(event_id % 3) else '' end as subject,
          case event_id % 5 when 0 then 'Can you please send the signed copy by Friday? About $' || TEXT(event_id % 90) || 'k.'
            when 1 then 'Thanks, all good. The order is completed.' when 2 then 'This is urgent and late; we are blocked.'
            when 3 then 'FYI only, no reply needed. Range $' || TEXT(event_id % 9 + 1) || ' - $' || TEXT(event_id % 90 + 10) || 'm.'
            else 'Owner: user' || TEXT(event_id % 23) || chr(10) || 'Due Date: tomorrow' || chr(10) || 'From: x' || chr(10) || 'old text' end as body_preview
        from events""",
    "issues": """
        select o_orderkey as id, o_custkey as project_id, case o_orderstatus when 'O' then 'active' when 'P' then 'waiting' else 'done' end as state,
          o_orderpriority as category, EPOCH(o_orderdate) as updated_at, o_orderdate as updated_time, EPOCH(o_orderdate) - (o_orderkey % 40) * 86400e0 as opened_at,
          EPOCH(o_orderdate) + 1209600e0 as due, o_totalprice as value_amount, case when o_orderkey % 9 = 0 then null else round(o_totalprice / 500000e0, 4) end as priority_score,
          'Order ' || TEXT(o_orderkey) || ' deal ' || TEXT(100000000 + o_custkey * 48271 % 899999) as title, 'user' || TEXT(o_custkey % 997) as contact, case when o_orderkey % 4 = 0 then 'Renewal ' || TEXT(o_custkey) end as display_title,
          o_orderkey % 5 = 0 as has_unmet_prerequisite, 'user' || TEXT(o_orderkey % 13) as owner
        from orders""",
    "projects": """
        select c_custkey as id, c_name as name, c_mktsegment as category, case when c_custkey % 10 = 0 then 'done' else 'active' end as status,
          c_nationkey % 6 as relationship_id from customer""",
    "parties": """
        select c_custkey as id, 'user' || TEXT(c_custkey) || '@' || case c_custkey % 5 when 0 then 'home.example' when 1 then 'no-reply.example' else 'acme-' || TEXT(c_custkey % 17) || '.co.uk' end as primary_email,
          'First' || TEXT(c_custkey % 40) || ' Last' || TEXT(c_custkey % 60) as display_name, case c_custkey % 5 when 0 then 'internal' when 1 then 'system_sender' else 'external' end as affiliation,
          case when c_custkey % 3 = 0 then '' else 'Company ' || TEXT(c_nationkey) end as company from customer""",
    "companies": """
        select s_suppkey as id, case s_suppkey % 6 when 0 then 'The ' else '' end || 'Firm' || TEXT(s_suppkey % 25) || case s_suppkey % 5 when 0 then ' Inc.' when 1 then ', LLC' when 2 then ' GmbH' when 3 then ' (Holdings)' else '' end as name,
          'mail.firm-' || TEXT(s_suppkey % 25) || case when s_suppkey % 2 = 0 then '.co.uk' else '.com' end as domain from supplier""",
    "claims": """
        select (l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 7 + l_suppkey * 977 + LONG(round(l_extendedprice * 100, 0))) % 1000000 as id, l_orderkey as issue_id, l_partkey as raw_item_id,
          case when l_linenumber = 7 then 'date' when l_returnflag = 'A' then 'ask' when l_returnflag = 'N' then 'commitment' else 'decision' end as claim_type,
          case when l_linestatus = 'O' then 'open' when l_linenumber % 2 = 0 then 'superseded' else 'done' end as status,
          'Send part ' || TEXT(l_partkey % 97) || ' worth $' || TEXT(LONG(l_quantity)) || 'k by the date' as text, 'user' || TEXT(l_suppkey % 13) as owner,
          'user' || TEXT(l_suppkey % 29) || '@firm' || TEXT(l_suppkey % 7) || '.example' as author, l_partkey as canonical_key, l_suppkey as supplier_id,
          EPOCH(l_shipdate) as first_seen_ts, EPOCH(l_shipdate) + (l_orderkey % 5) * l_quantity * 86400e0 as last_seen_ts, l_extendedprice as amount,
          case when l_linenumber = 7 and l_quantity > 25 then 'hard' when l_linenumber = 7 then 'soft' end as date_kind, l_quantity >= 45 as escalated,
          case when l_quantity >= 45 then 'R' || TEXT(l_partkey) end as reference_base
        from lineitem""",
    "links": """select distinct l_orderkey as issue_id, 'R' || TEXT(l_partkey) as reference from lineitem where l_quantity >= 45""",
    "descriptors": "select l_orderkey as issue_id, 'supply of ' || case l_partkey % 3 when 0 then 'small' when 1 then 'polished' else 'heavy duty' end || ' fittings grade ' || TEXT(l_partkey % 40) as descriptor from lineitem where l_linenumber = 7",
    "issue_texts": """
        select o_orderkey as issue_id, case o_orderkey % 6
            when 0 then 'This is a Flow-Down from the existing FIRM' || TEXT(o_custkey % 25) || ' subcontract'
            when 1 then 'the firm' || TEXT(o_custkey % 30) || repeat(' filler', cast(o_orderkey % 60 as int)) || ' teaming agreement of ' || TEXT(o_orderkey)
            when 2 then 'A mail about firm' || TEXT(o_custkey % 25) || ' and nothing else'
            when 3 then 'change order under ' || repeat('x', cast(o_orderkey % 300 as int)) || 'firm' || TEXT(o_custkey % 25)
            when 4 then 'firm' || TEXT(o_custkey % 25) || ' (holdings)' || repeat('. Later', cast(o_orderkey % 45 as int)) || ' a prime contract, then a sub-contract with the firm' || TEXT(o_orderkey % 25) else '' end as text from orders""",
    "definitions": "select * from (values ('discount', 'ask'), ('delivery', 'commitment'), ('penalty', 'decision')) as t(definition, claim_type)",
    "messages": "select conv_id, turn, role, text, case role when 'user' then 'inbound' when 'assistant' then 'outbound' else 'internal' end as direction, turn * 50e0 + conv_id % 7 as ts from conversations",
    "documents_": "select doc_id as id, text, lang, source from documents",
    "pages_": "select page_id as id, url, html from pages",
    "outcomes": "select doc_id as id, case quality when 1 then 'accepted' else 'dismissed' end as outcome, toxic = 1 as rewritten, case doc_id % 3 when 0 then 'reply' when 1 then 'escalate' else 'close' end as action_kind from labels",
    "scores": "select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq, round(l_discount * 5 + l_tax, 4) as score, EPOCH(l_shipdate) as ts from lineitem",
    "rules": """select * from (values (1, 'signup', 'purchase'), (2, 'click', 'purchase'), (3, 'view', 'error'), (4, 'error', 'signup')) as t(rule_id, requires_type, trigger_type)""",
    "vetoes": "select o_orderkey as id_a, o_orderkey + 7 as id_b from orders where o_orderkey % 50 = 0",
    "containers": "select TEXT(o_custkey) as thread_key, min(o_orderkey) as issue_id from orders where o_custkey % 3 = 0 group by o_custkey",
    "issue_evidence": """
        select o_orderkey as issue_id, 'Invoice approved for ' || case o_orderkey % 3 when 0 then 'click' when 1 then 'signup' else 'purchase' end || ' PR' || TEXT(o_orderkey % 50) as subject,
          'mail.firm' || TEXT(o_orderkey % 7) || '.example' as domain from orders""",
    "closures": """select * from (values ('click', 'purchase'), ('view', 'signup')) as t(request_type, closure_type)""",
    "actions": "select event_id as id, user_id as issue_id, EPOCH(ts) as requested_ts, case event_id % 3 when 0 then 'done' when 1 then 'pending' else 'running' end as status, event_type as action_kind from events",
    "states": "select o_orderkey as issue_id, o_orderkey % 3 as n, case when o_orderkey % 2 = 0 then 'waiting' else 'active' end as to_state, 'active' as from_state, EPOCH(o_orderdate) as changed_ts, case when o_orderkey % 4 < 3 then 'user' || TEXT(o_orderkey % 5) end as actor from orders",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def used(text: str) -> list[str]:
    """The views and tables that a statement reads."""
    words = set(re.findall(r"(?:from|join) +([a-z_]+)", text))
    words -= set(re.findall(r"(?:with(?: +recursive)?|,)\s+([a-z_]+) as \(", text))  # the statement's own names
    return [v for v in [*VIEWS, *TABLES] if v in words]
