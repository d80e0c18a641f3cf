"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from weftline.llm import ann, bpe, chat, ctw, embdedup, minhash, packing, phrases, quality, sharding, toxicity, urlrules, vectorcodes
from weftline.sources.tables import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_crf_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_cnn_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_rules(spark, sf_dir):
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_learned_partitions(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_context_tree_weighting(spark, sf_dir):
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_cross_polytope_dedup(spark, sf_dir):
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_hash_tree_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_segment_tree_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op12_vector_codes(spark, sf_dir):
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") or k == "pipeline"}


OP3_SQL = """
with a as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) as raw from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) as path from b),
d as (select page_id, host, path, '.' || host as h from c)
select page_id, host, path,
  case when h like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
       when h like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
       when h like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
       when h like '%.net' and starts_with(path, '/') then 'net/' end as rule,
  case when h like '%.example.net' and starts_with(path, '/en/') then 'allow'
       when h like '%.example.com' and starts_with(path, '/de/') then 'block'
       when h like '%.org' and starts_with(path, '/fr/') then 'allow'
       when h like '%.net' and starts_with(path, '/') then 'block' else 'allow' end as verdict
from d
"""


OP11_SQL = r"""
with rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (select *, length(regexp_replace(role || chr(1) || text, '([<\[])(\\*)(/?INST\]|/?s>|(?:IMAGE|AUDIO|DOCUMENT)\])', '\1\\\2\3', 'g')) - 1 as n from rows_)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + length('[INST][/INST]</s>')) as bigint) as formatted_chars
from marked group by conv_id
"""


def _op12_sql() -> str:
    """Each round as three steps: books of the round before, nearest entries, sums."""
    steps = ["""kept as (select row_number() over (order by vec_id, v) as r, vec_id, label, v from (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0) k),
    parts_ as materialized (select r, vec_id, label, p, list_slice(v, len(v) // 4 * p + 1, len(v) // 4 * (p + 1)) as x from kept cross join range(4) as t(p)),
    book0 as materialized (select p, cast(r - 1 as int) as e, x as c from parts_ where r <= 256)"""]
    for k in range(5):
        steps.append(f"""near{k} as materialized (select r, vec_id, label, s.p, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e := e)) as best from parts_ s join book{k} b on s.p = b.p group by r, vec_id, label, s.p)""")
        if k < 4:
            steps.append(f"""sums{k} as (select p, e, list(total order by place) as c from (select p, best.e as e, place, floor(sum(y) / count(*)) as total from (select s.p, n.best, unnest(x) as y, generate_subscripts(x, 1) as place from parts_ s join near{k} n using (r, p)) u group by p, best.e, place) g group by p, e),
    book{k + 1} as materialized (select b.p, b.e, coalesce(s.c, b.c) as c from book{k} b left join sums{k} s on b.p = s.p and b.e = s.e)""")
    return "with " + ",\n    ".join(steps) + """,
    coded as (select r, vec_id, label, string_agg(printf('%02x', best.e), '' order by p) as code, cast(sum(best.d) as bigint) as error from near4 group by r, vec_id, label),
    books as (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by p, e, place)) as codebooks_sha256 from (select p, e, unnest(c) as y, generate_subscripts(c, 1) as place from book4) u)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded cross join books"""


OP13_SQL = r"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
told as (select lang, list_filter(string_split_regex(piece, '[ \t]'), lambda w: w <> '') as w from pieces),
grams as (select lang, k as len, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from told cross join range(1, 4) as t(k)) g),
counts as materialized (select lang, len, phrase, count(*) as a from grams group by lang, len, phrase),
totals as (select lang, cast(sum(a) as bigint) as n from counts where len = 1 group by lang),
candidates as materialized (select lang, len, phrase, a, string_split(phrase, ' ') as w from counts where len > 1 and a >= 10),
around as (select lang, phrase, max(a) as around from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase from candidates where len = 3) x group by lang, phrase),
kept as (select c.* from candidates c left join around o on c.lang = o.lang and c.phrase = o.phrase where o.around is null or 100 * o.around < 50 * c.a),
cuts as (select lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') as first, array_to_string(list_slice(w, k + 1, len), ' ') as rest from (select *, unnest(range(1, len)) as k from kept) x),
scored as (select c.lang, c.phrase, c.a, min(struct_pack(score := cast((1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as bigint), k := k, l := l.a, r := r.a)) as cut
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.first join counts r on r.lang = c.lang and r.phrase = c.rest group by c.lang, c.phrase, c.a),
ranked as (select lang, row_number() over (partition by lang order by cut.score desc, a desc, encode(phrase)) as rank, phrase, a, cut.l as l, cut.r as r, cut.score as score from scored)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def oracle_sql():
    return {"op3_url_rules": OP3_SQL, "op11_chat_formatting": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_phrase_collocations": OP13_SQL}
