"""Text functions as SQL expressions over a column expression (rendered by plans.dialect)."""

from __future__ import annotations

# Fixed values, equal to the reference's because results depend on them: the legal suffix taken off a name's end and the
# separators before it, the legal forms taken out of a name anywhere, and the stop words of situation signatures.
LEGAL_SUFFIX = "(inc|incorporated|llc|l[.]l[.]c|ltd|limited|corp|corporation|co)"
SEPARATORS = " .,;:&-"
LEGAL_TOKENS = (
    "inc incorporated llc llp lllp ltd limited corp corporation co company plc gmbh ag sa sas sarl bv nv ab as oy oyj pty kk spa srl aps kg mbh pte"
).split()
STOP_WORDS = (
    "the a an of for to in on and or is are was were be with at by from as that this it what how when which who we our i do does can should will have has had any there"
).split()
#: The escape of both engines' patterns, which literals of the two write in different ways.
_ESC = "chr(92)"
FILE_NOISE = ["final", "draft", "copy", "signed", "version", "docx", "pdf", "xlsx", "doc"]


def quoted(words) -> str:
    return "ARRAY(" + ", ".join(f"'{w}'" for w in words) + ")"


def normalize_company_name(x):
    """Lower case, one legal suffix at the end removed, then separators at the end."""
    bare = f"trim(REPLACE_ALL(' ' || lower(trim({x})), '[^a-z0-9_]{LEGAL_SUFFIX}[.]?[ ]*$', ' '))"
    return f"coalesce(trim(REPLACE_ALL({bare}, '[{SEPARATORS}]+$', '')), '')"


def entity_key(x):
    """Words without a trailing parenthesis, punctuation but `&`, a leading `the` and legal forms anywhere; `A/S` is one form.

    Texts are taken as they are; operators.imperative.nfkc folds compatibility forms before.
    """
    bare = f"lower(REPLACE_ALL(trim({x}), '[ ]*[(][^()]*[)]$', ''))"
    marks = f"REPLACE_ALL({bare}, '[^' || {_ESC} || 'pL' || {_ESC} || 'pN_ &/]', ' ')"
    folded = f"' ' || REPLACE_ALL(REPLACE_ALL({marks}, ' */ *', '/'), ' ', '  ') || ' '"
    for a in "as":
        for b in "as":
            folded = f"replace({folded}, ' {a}/{b} ', ' {a}{b} ')"
    words = f"trim(REPLACE_ALL(replace({folded}, '/', ' '), ' +', ' '))"
    return f"coalesce(JOINED(FILTER(SPLIT(REPLACE_ALL({words}, '^the( |$)', ''), ' '), w, w <> '' and not CONTAINS({quoted(LEGAL_TOKENS)}, w)), ' '), '')"


def reference_base(x):
    return f"REPLACE_ALL({x}, '-V[0-9]+$', '')"


def strip_subject_prefix(x):
    return f"trim(REPLACE_ALL({x}, '^( *([Rr][Ee]|[Ff][Ww][Dd]?) *: *)+', ''))"


def normalize_subject(x):
    return f"lower({strip_subject_prefix(x)})"


def conservative_normalize(x):
    return f"trim(REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(lower({x}), '(please|kindly|thank you|thanks)', ' '), '[^a-z0-9$ ]+', ' '), ' +', ' '))"


def sender_domain(x):
    return f"case when {x} like '%@%' then lower(trim(REPLACE_ALL({x}, '^.*@', ''))) end"


def company_from_domain(x):
    """The registrable label of a domain in title case; two-part public endings such as co.uk count as one."""
    parts = f"SPLIT({x}, '[.]')"
    label = f"case when SIZE({parts}) >= 3 and CONTAINS(ARRAY('co', 'com', 'org', 'ac'), AT({parts}, -2)) then AT({parts}, -3) else AT({parts}, -2) end"
    return f"TITLE(replace({label}, '-', ' '))"


def classify_affiliation(x, internal="home.example"):
    return (
        f"case when {x} is null or {x} not like '%@%' then 'unknown' when split_part(lower({x}), '@', 2) = '{internal}' then 'internal' "
        f"when LIKES(lower({x}), '(no-?reply|donotreply|notifications?|mailer-daemon)') then 'system_sender' else 'external' end"
    )


def dollar_amounts(x):
    """Dollar figures with k, m or bn, as numbers in the order of the text."""
    one = "FLOAT(replace(regexp_extract(w, '[0-9][0-9,]*[.]?[0-9]*', 0), ',', '')) * case lower(regexp_extract(w, '(k|m|bn)$', 1)) when 'k' then 1000e0 when 'm' then 1000000e0 when 'bn' then 1000000000e0 else 1e0 end"
    return f"MAP_EACH(EXTRACT_ALL(lower({x}), '([$][ ]?[0-9][0-9,]*[.]?[0-9]*[ ]?(bn|k|m)?)', 1), w, {one})"


def situation_signature(x):
    return f"JOINED(UNIQUE(FILTER(EXTRACT_ALL(lower({x}), '([a-z0-9]+)', 1), w, length(w) >= 3 and not CONTAINS({quoted(STOP_WORDS)}, w))), '|')"


def filename_core_tokens(x):
    return f"UNIQUE(FILTER(SPLIT(REPLACE_ALL(lower({x}), '[^a-z0-9]+', ' '), ' '), w, w <> '' and not CONTAINS({quoted(FILE_NOISE)}, w) and not LIKES(w, '^[0-9]$')))"


def action_family(x):
    return (
        f"case when LIKES(lower({x}), '(sign|countersign|execute)') then 'sign' when LIKES(lower({x}), '(approve|approval)') then 'approve' "
        f"when LIKES(lower({x}), '(review|redline)') then 'review' when LIKES(lower({x}), '(send|share|forward)') then 'send' when LIKES(lower({x}), '(pay|invoice)') then 'pay' end"
    )


def canonical_key(claim_type, text, owner, reference):
    """The kind, action family (else generic), reference and owner where there is a reference; else the kind and a normalised text of 8 characters and more."""
    norm = conservative_normalize(text)
    return (
        f"case when nullif({reference}, '') is not null then {claim_type} || '|' || coalesce({action_family(text)}, 'generic') || '|' || {reference} || '|' || coalesce(nullif({owner}, ''), 'unknown') "
        f"when length({norm}) >= 8 then {claim_type} || '|text:' || {norm} end"
    )


def strip_quoted_reply(x):
    boundary = f"FIND({x}, chr(10) || 'From:')"
    return f"trim(case when {boundary} > 0 then substr({x}, 1, {boundary} - 1) else {x} end)"


def estimate_tokens(x):
    return f"greatest(1, IDIV(LONG(length({x})), 4))"


def situation_key(category, company):
    return f"case when {category} is null or {category} in ('', 'other') or {company} is null or {company} = '' then null else 'category:' || lower({category}) || '|company:' || lower({company}) end"


#: (type, sender's domain or None, pattern, treatment), the first match wins. Those of the queries; a caller has rules of its own.
SIGNAL_RULES = [
    ("portal_approval", "mail.firm0.example", "approve", "actionable"),
    ("portal_approval", "mail.firm1.example", "approve", "actionable"),
    ("meeting", None, "meeting:", "fyi"),
    ("out_of_office", None, "out of office", "noise"),
    ("approval_complete", None, "invoice approved", "closure"),
    ("approval_request", None, "action required: approve", "actionable"),
    ("review_request", None, "please review", "actionable"),
    ("status_request", None, "status of", "fyi"),
]


def _signal(subject, sender, rules, pick):
    whens = []
    for rule in rules:
        domain, pattern = rule[1], rule[2]
        own = f"coalesce({sender_domain(sender)}, '')"
        at = f"({own} = '{domain}' or {own} like '%.{domain}') and " if domain else ""
        whens.append(f"when {at}LIKES(lower({subject}), '{pattern}') then {pick(rule)}")
    return f"case {' '.join(whens)} end"


def classify_signal(subject, sender, rules=SIGNAL_RULES):
    """The type of the first rule in order whose sender domain (or a subdomain of it) and pattern fit."""
    return _signal(subject, sender, rules, lambda r: f"'{r[0]}'")


def signal_treatment(subject, sender, owner=None, promoted=(), rules=SIGNAL_RULES):
    """The treatment of that rule; a `promoted` type whose subject names the owner is actionable."""

    def pick(r):
        if owner and r[0] in promoted:
            return f"case when contains(lower({subject}), lower({owner})) then 'actionable' else '{r[3]}' end"
        return f"'{r[3]}'"

    return _signal(subject, sender, rules, pick)


def value_urgency(v):
    return f"case when {v} < 1000 then 0e0 else least(1e0, greatest(0e0, (log10({v}) - 3e0) / 5e0)) end"


def staleness_urgency(ts, saturation="14e0", now=":now"):
    return f"least(1e0, (({now}) - {ts}) / 86400e0 / {saturation})"


def due_urgency(due, now=":now"):
    return f"case when {due} is null then 0e0 when {due} < {now} then 1e0 else greatest(0e0, 1e0 - ({due} - {now}) / 86400e0 / 14e0) end"


# Fixed values, equal to the reference's because results depend on them: the patterns of message intents, the first of each
# kind that fits counts. MANAGER and MEMBERS stand for the manager's name and the members' short names.
INTENTS = [
    ("needs_manager", "0.85e0", [r"@MANAGER\b", r"\bneeds? MANAGER\b", r"\bescalat(?:e|ing) to MANAGER\b", r"\bMANAGER.{0,30}(?:decision|approval|sign[- ]?off|input|to (?:decide|approve|review))"]),
    ("blocked_on", "0.7e0", [r"\b(?:blocked on|waiting for|stuck on|can'?t (?:proceed|continue|ship)|need(?:s)? .+ before)\b", r"\b(?:unable to|prevented from)\s+\w+"]),
    ("asking_question", "0.6e0", [r"\?\s*$", r"^(?:can|could|would|should|will|do|does|is|are)\s.+\?", r"\bwhat (?:do|does|is|are|would|should|about)\b.+\?"]),
    ("handoff", "0.7e0", [
        r"\b(?:MEMBERS)[:,]\s+(?:please|can you|could you|need you to|own this|take this|action item|take action|action for)\b",
        r"\b(?:handing off to|handoff to|over to|action item for|ownership goes to)\s+(?:MEMBERS)\b",
    ]),
    ("proposing_decision", "0.55e0", [r"^\s*(?:proposal|recommendation|recommend|suggest|let'?s|i propose|propose to)\b", r"\bdecision:\s+"]),
    ("completed", "0.5e0", [
        r"\b(?:done|shipped|landed|merged|completed|finished|wrote|built|deployed|published)\b.{0,80}\b(?:it|that|this|the .+|to .+)\b",
        r"^\s*(?:✓|✅|done\.|shipped\.|complete\.|finished\.)",
    ]),
]
ADDRESSED = [r"\b(?:ask|tell|ping|notify|hand off to|loop in|cc) WHO\b", r"\bWHO: ", r"\bWHO,\s+", r"\bWHO (?:will|can|should|needs to|please|owns)", r"\bfor WHO\b"]


def raw(pattern: str) -> str:
    """A pattern as an expression of both engines; apostrophes are joined in."""
    return "(" + " || chr(39) || ".join(f"RAW('{part}')" for part in pattern.split("'")) + ")"


def target_member(text: str, actor: str, members: dict[str, str]) -> str:
    """The member whom a text mentions with an @, else the first one that it addresses; never the actor."""
    whens = [f"when coalesce({actor} <> '{who}', true) and LIKES(lower({text}), {raw(p.replace('WHO', short))}) then '{who}'" for patterns in ([r"@WHO\b"], ["|".join(ADDRESSED)]) for p in patterns for short, who in members.items()]
    return f"case {' '.join(whens)} end"


def intent_around(text: str, patterns, manager: str, members: dict[str, str]) -> str:
    """What stands within 80 characters of the first pattern that fits, on one line; null where none does."""
    cases = []
    for p in patterns:
        p = p.replace("MANAGER", manager).replace("MEMBERS", "|".join(members))
        found = raw(rf"\A((?s:.*?))((?im:{p}))")
        before, hit = f"length(regexp_extract({text}, {found}, 1))", f"length(regexp_extract({text}, {found}, 2))"
        inner = f"trim(replace(substr({text}, greatest(0, {before} - 80) + 1, least(length({text}), {before} + {hit} + 80) - greatest(0, {before} - 80)), chr(10), ' '))"
        cases.append(f"when LIKES({text}, {raw(f'(?im:{p})')}) then case when {before} > 80 then '…' else '' end || {inner} || case when {before} + {hit} + 80 < length({text}) then '…' else '' end")
    return f"case {' '.join(cases)} end"
