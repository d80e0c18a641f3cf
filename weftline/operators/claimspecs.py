"""Claims of extraction results, which are JSON of whatever shape a model gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.plans.dialect import render
from weftline.plans.registry import query
from weftline.plans.views import view

#: The lists of a result, and the type of their claims.
LISTS = {"asks": "ask", "decisions": "decision", "commitments": "commitment"}


def _list(field: str) -> Column:
    """A field's elements as variants, none where it isn't a list."""
    return F.coalesce(F.try_variant_get("v", f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))


def _text(x: Column, path: str = "$") -> Column:
    """A text without the white space around it; null for what isn't a text, or is blank."""
    found = F.try_variant_get(x, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.regexp_replace(F.try_variant_get(x, path, "string"), r"^\s+|\s+$", ""), F.lit("")))


def claim_specs(blobs: DataFrame) -> DataFrame:
    """id, claim_type, place, text, owner, date_kind and canonical_key of the claims of `blobs` (id, author, reference_base, value).

    `author` is manager or counterparty, else unknown. `place` counts from 0 in the claim's list. Lists that aren't
    lists, elements that aren't texts (of dates: objects with a text) and blank texts give no claim, nor does what isn't
    a JSON object. The author owns commitments and the other side owns asks; a date is whose it says.
    """
    rows = blobs.withColumn("v", F.try_parse_json("value"))
    author = F.when(F.col("author").isin("manager", "counterparty"), F.col("author")).otherwise("unknown")
    other = F.when(F.col("author") == "manager", "counterparty").when(F.col("author") == "counterparty", "manager").otherwise("unknown")
    owners = {"ask": other, "decision": F.lit(None).cast("string"), "commitment": author}

    def spec(kind, owner, text, date_kind=None):
        return F.struct(F.lit(kind).alias("claim_type"), text.alias("text"), owner.alias("owner"), (F.lit(None) if date_kind is None else date_kind).cast("string").alias("date_kind"))

    def placed(specs):
        return F.transform(specs, lambda s, at: F.struct(at.alias("place"), s.alias("s")))

    def date(x):
        kind, whose = (F.try_variant_get(x, path, "string") for path in ("$.kind", "$.whose"))
        return spec("date", F.when(whose.isin("manager", "counterparty"), whose).otherwise("unknown"), _text(x, "$.text"), F.when(kind.isin("hard", "soft"), kind))

    def texts(kind):
        return lambda x: spec(kind, owners[kind], _text(x))

    lists = [placed(F.transform(_list(field), texts(kind))) for field, kind in LISTS.items()]
    lists.append(placed(F.transform(_list("dates_mentioned"), date)))
    found = rows.select("id", "reference_base", F.explode(F.concat(*lists)).alias("c")).where("c.s.text is not null").select("id", "reference_base", "c.place", "c.s.*")
    key = render(t.canonical_key("claim_type", "text", "owner", "reference_base"), True)
    return found.selectExpr("id", "claim_type", "place", "text", "owner", "date_kind", f"{key} as canonical_key")


_SPECS = f"""
    with side as (select *, case direction when 'outbound' then 'manager' when 'inbound' then 'counterparty' else 'unknown' end as author, case direction when 'outbound' then 'counterparty' when 'inbound' then 'manager' else 'unknown' end as other from raw_items where id % 50 not in (7, 8)),
    specs as (
      select id, pr_number_base, 'ask' as claim_type, 0 as place, trim(case when id % 5 = 0 then body_preview else subject end) as text, other as owner, cast(null as varchar) as date_kind from side where id % 5 <> 1
      union all select id, pr_number_base, 'ask', 2, trim(subject), other, null from side where id % 5 = 0
      union all select id, pr_number_base, 'decision', 0, trim(subject), null, null from side where id % 3 = 0
      union all select id, pr_number_base, 'commitment', 1, trim(body_preview), author, null from side where id % 4 = 1
      union all select id, pr_number_base, 'date', 0, trim(subject), case k % 4 when 0 then 'manager' when 1 then 'counterparty' else 'unknown' end, case id % 3 when 0 then 'hard' when 1 then 'soft' end from side where id % 2 = 0)
    select id, claim_type, place, text, owner, date_kind, {t.canonical_key('claim_type', 'text', 'owner', 'pr_number_base')} as canonical_key from specs"""


@query("n02_claim_specs", _SPECS)
def specs_of_items(spark, sf_dir):
    """Results of many shapes, one an item, as their claims."""
    items = view(spark, sf_dir, "raw_items")
    date = "to_json(named_struct('text', subject, 'kind', element_at(array('hard', 'soft', 'never'), cast(id % 3 as int) + 1), 'whose', try_element_at(array('manager', 'counterparty', 'shared'), k % 4 + 1)))"
    fields = [
        "'{\"asks\":'", "case id % 5 when 0 then to_json(array(body_preview, '  ', subject)) when 1 then substr(to_json(array(body_preview)), 2, length(to_json(array(body_preview))) - 2) else to_json(array(' ' || subject || ' ')) end",
        "if(id % 3 = 0, ',\"decisions\":' || to_json(array(subject)), '')", "if(id % 4 = 1, ',\"commitments\":[7,' || substr(to_json(array(body_preview)), 2), ',\"commitments\":null')",
        f"if(id % 2 = 0, ',\"dates_mentioned\":[' || {date} || ',\"loose\",5]', '')", "'}'",
    ]
    blob = f"case id % 50 when 7 then '{{cut' when 8 then '[\"asks\"]' else concat({', '.join(fields)}) end as value"
    return claim_specs(items.selectExpr("id", "case direction when 'outbound' then 'manager' when 'inbound' then 'counterparty' end as author", "pr_number_base as reference_base", blob))
