"""Operators are written once, in SQL with a few macros; this renders them for Spark and for DuckDB.

A macro is a name in capitals with its arguments in parentheses, such as EPOCH(ts). Patterns use character
classes and no backslashes, so that both engines read the same literal, or are RAW literals.
"""

from __future__ import annotations

#: name: (Spark, DuckDB), with {0}, {1}, ... for the arguments.
MACROS = {
    "EPOCH": ("(unix_micros(cast({0} as timestamp)) / 1000000e0)", "epoch({0})"),
    "EPOCH_ISO": ("(unix_micros(try_cast({0} as timestamp)) / 1000000e0)", "epoch(try_cast({0} as timestamp))"),
    "LIKES": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "RAW": ("r{0}", "{0}"),
    "REPLACE_ALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "EXTRACT_ALL": ("regexp_extract_all({0}, {1}, {2})", "regexp_extract_all({0}, {1}, {2})"),
    "SPLIT": ("split({0}, {1})", "string_split_regex({0}, {1})"),
    "LIST": ("array_sort(collect_list({0}))", "coalesce(list_sort(list({0}) filter (where {0} is not null)), [])"),
    "SET": ("array_sort(collect_set({0}))", "coalesce(list_sort(list(distinct {0}) filter (where {0} is not null)), [])"),
    "JOINED": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "SIZE": ("size({0})", "cast(len({0}) as int)"),
    "FILTER": ("filter({0}, {1} -> {2})", "list_filter({0}, lambda {1}: {2})"),
    "MAP_EACH": ("transform({0}, {1} -> {2})", "list_transform({0}, lambda {1}: {2})"),
    "ANY_OF": ("exists({0}, {1} -> {2})", "(len(list_filter({0}, lambda {1}: {2})) > 0)"),
    "SORTED": ("array_sort({0})", "list_sort({0})"),
    "UNIQUE": ("array_sort(array_distinct({0}))", "list_sort(list_distinct({0}))"),
    "CONTAINS": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "SHARED": ("array_sort(array_intersect({0}, {1}))", "list_sort(list_intersect({0}, {1}))"),
    "FIRST_N": ("slice({0}, 1, {1})", "list_slice({0}, 1, {1})"),
    "AT": ("try_element_at({0}, {1})", "list_extract({0}, {1})"),
    "ARRAY": ("array({*})", "[{*}]"),
    "UNNEST": ("explode({0})", "unnest({0})"),
    "SHA256": ("sha2({0}, 256)", "sha256({0})"),
    "IDIV": ("({0} div {1})", "({0} // {1})"),
    "MEDIAN": ("percentile({0}, 0.5e0)", "quantile_cont({0}, 0.5e0)"),
    "MONTH": ("date_format({0}, 'yyyy-MM')", "strftime({0}, '%Y-%m')"),
    "DAY": ("date_format({0}, 'yyyy-MM-dd')", "strftime({0}, '%Y-%m-%d')"),
    "HHMM": ("date_format({0}, 'HH:mm')", "strftime({0}, '%H:%M')"),
    "JSON": ("get_json_object({0}, '$.' || {1})", "({0} ->> {1})"),
    "JSON_LIST": ("from_json({0}, 'array<string>')", "cast({0} as varchar[])"),
    "MONTHS": ("sequence(add_months(date_trunc('month', {0}), 1 - {1}), date_trunc('month', {0}), interval 1 month)",
               "generate_series(date_trunc('month', {0}) - to_months({1} - 1), date_trunc('month', {0}), interval 1 month)"),
    "SPAN": ("sequence({0}, {1})", "generate_series({0}, {1})"),
    "THOUSANDS": ("format_number(cast(round({0}, 0) as bigint), 0)", "format('{:,}', cast(round({0}, 0) as bigint))"),
    "TEXT": ("cast({0} as string)", "cast({0} as varchar)"),
    "FLOAT": ("cast({0} as double)", "cast({0} as double)"),
    "WHOLE": ("cast({0} as bigint)", "cast(trunc({0}) as bigint)"),
    "LAST_KNOWN": ("last_value({0}) ignore nulls", "last_value({0} ignore nulls)"),
    "LONG": ("cast({0} as bigint)", "cast({0} as bigint)"),
    "TOLONG": ("try_cast({0} as bigint)", "try_cast({0} as bigint)"),
    "TOFLOAT": ("try_cast({0} as double)", "try_cast({0} as double)"),
    "SUMS": ("sum({0})", "cast(sum({0}) as bigint)"),
    "FIND": ("instr({0}, {1})", "cast(strpos({0}, {1}) as int)"),
    "TITLE": ("initcap({0})", "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose parenthesis opens before `at`, and where it ends."""
    out, depth, start, quoted = [], 0, at, False
    while True:
        c = text[at]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c in "([":
                depth += 1
            elif c == ")" and depth == 0:
                return [*out, text[start:at].strip()], at + 1
            elif c in ")]":
                depth -= 1
            elif c == "," and depth == 0:
                out.append(text[start:at].strip())
                start = at + 1
        at += 1


def render(text: str, spark: bool) -> str:
    out, at, quoted = [], 0, False
    while at < len(text):
        c = text[at]
        if c == "'":
            quoted = not quoted
        if not quoted and (c.isupper() or c == "_") and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")):
            end = at
            while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                end += 1
            name = text[at:end]
            if name in MACROS and text[end : end + 1] == "(":
                args, at = _arguments(text, end + 1)
                args = [render(a, spark) for a in args]
                form = MACROS[name][0 if spark else 1].replace("{*}", ", ".join(args))
                for k, a in enumerate(args):
                    form = form.replace("{%d}" % k, a)
                out.append(form)
                continue
            out.append(name)
            at = end
            continue
        out.append(c)
        at += 1
    return "".join(out)
