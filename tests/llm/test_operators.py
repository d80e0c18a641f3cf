"""The training-data operators on small fixtures, against brute force, round trips and the cases their docstrings define."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, bpe, chat, ctw, embdedup, minhash, packing, phrases, quality, sharding, toxicity, urlrules, vectorcodes

tokenizers_files = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = prose(rng, 60)
    near = base.split()
    near[30] = "changed"
    far = base.split()[:30] + prose(rng, 30).split()
    long = prose(rng, 40_000)
    return [base, base, " ".join(near), " ".join(far), base.upper(), "", None, "  \n\t ", "one two", "one  two", "ONE TWO", long, long + " tail", "'s it's  x\n\n y  ", "日本語 テスト é", "a" * 3000, prose(rng, 400)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with a null and a repeat, and columns whose names the operators use themselves."""
    ids = [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, None]
    rows = [(i, t, "en", "src", None, 1, "x", 0.5, "k") for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep long, label string, score double, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def labels_of(spark, docs):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(10, 26)] + [(None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# 5


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, u) in itertools.combinations(sets, 2):
        if s and 100 * len(s & u) >= 75 * len(s | u):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_match_brute_force(docs):
    got = minhash.near_duplicates(docs).collect()
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = components(pairs)
    assert len(got) == len(pairs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_a_group_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = prose(rng, 120).split()
    rows = []
    for i in range(300):  # a chain of drifting copies: the ends share little
        base = list(base)
        base[rng.randrange(len(base))] = f"w{i}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == expected


def test_one_of_each_keeps_columns(docs):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 10 in ids and not {11, 12, 14} & ids and {15, 16, 17, None} <= ids


def test_sketches_fill_and_agree_like_jaccard():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    b = np.concatenate((a[:400], np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))))
    one = a[:1]
    s = minhash.sketch(np.concatenate((a, np.sort(b), one)), np.cumsum([0, len(a), len(b), 1]))
    assert (s != 0).all()
    jaccard = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((s[0] == s[1]).mean() - jaccard) < 0.12


# 1 and 2


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    e, a = rng.normal(size=9), rng.normal(size=(2, 2))
    total, ones = 0.0, np.zeros(9)
    for tags in itertools.product((0, 1), repeat=9):
        first = np.exp(0.4 * 0)  # start weight of state 0 before the first token
        s = 0.0
        for prev in (0, 1):
            s += np.exp(0.4 * prev + a[prev, tags[0]])
        w = first * s * np.exp(sum(a[x, y] for x, y in zip(tags, tags[1:])) + e[np.array(tags) == 1].sum())
        total += w
        ones += w * np.array(tags)
    assert np.allclose(toxicity.marginals(e, np.array([0, 9]), a, 0.4), ones / total)
    long = rng.normal(size=100)
    split = toxicity.marginals(np.concatenate((e, long)), np.array([0, 9, 9, 109]), a, 0.4)
    assert np.allclose(split[:9], ones / total) and np.allclose(split[9:], toxicity.marginals(long, np.array([0, 100]), a, 0.4))


def toxic_sample(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = prose(rng, rng.randrange(20, 120)).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vilxa", "vilxo", "grumpf"]))
        rows.append((" ".join(w), int(i % 4 == 0)))
    return pd.DataFrame(rows, columns=["text", "label"])


def test_quality_equals_a_direct_net():
    """Every window, filter and chunk by plain loops."""
    net = quality.new_net()
    rng = random.Random(2)
    texts = ["", "a", "é", prose(rng, 3), prose(rng, 9), prose(rng, 40), prose(rng, 200)]
    expected = []
    for t in texts:
        raw = t.encode()
        blocks = max(2, -(-(len(raw) + quality.WIDTH) // quality.BLOCK))
        x = net.embed[np.frombuffer(raw.ljust(blocks * quality.BLOCK, b"\0"), np.uint8)]
        windows = {at: x[at : at + quality.WIDTH].reshape(-1) @ net.filters for at in range(0, len(x) - quality.WIDTH + 1, quality.STRIDE)}
        units = np.zeros(quality.UNITS)
        for b in range(blocks - 1):
            chunk = [v for at, v in windows.items() if b * quality.BLOCK <= at < (b + 2) * quality.BLOCK]
            pooled = np.maximum(np.max(chunk, axis=0) + net.filter_bias, 0)
            units = np.maximum(units, np.maximum(pooled @ net.dense + net.dense_bias, 0))
        expected.append(1 / (1 + math.exp(-(units @ net.out + net.out_bias[0]))))
    assert np.allclose(quality.probabilities(net, texts), expected, atol=1e-5)
    assert np.allclose([quality.probabilities(net, [t])[0] for t in texts], expected, atol=1e-5)


def test_toxic_spans_are_found():
    model = toxicity.fit(toxic_sample())
    test = toxic_sample(200, 9)
    found = toxicity.Tagger(model).score(test["text"].tolist())
    assert ((found["score"] >= 0.5).astype(int) == test["label"]).mean() > 0.97
    text = "Ein İ Satz, VILXO! alpha1"
    span = toxicity.Tagger(model).score([text])["spans"][0]
    assert [text[s["start"] : s["end"]] for s in span] == ["VILXO"]


def test_quality_net_learns_and_covers_whole_texts():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        t = prose(rng, rng.randrange(30, 150))
        if i % 3 == 0:
            t += " " + " ".join(w + "$$$%%%" for w in prose(rng, 40).split())
        rows.append((t, int(i % 3 != 0)))
    net = quality.fit(pd.DataFrame(rows, columns=["text", "label"]))
    p = quality.probabilities(net, [t for t, _ in rows])
    assert ((p >= 0.3) == np.array([y == 1 for _, y in rows])).mean() > 0.97
    assert np.allclose(p[:20], [quality.probabilities(net, [t])[0] for t, _ in rows[:20]], atol=1e-4)
    long = prose(rng, 200_000)
    tail = long + " " + " ".join(w + "$$$%%%" for w in prose(rng, 40).split())
    assert len(long) > quality.GROUP and quality.probabilities(net, [tail])[0] < 0.3
    assert quality.probabilities(net, [long, None, ""]).shape == (3,)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, docs, empty, module):
    got = module.score_documents(docs, labels_of(spark, docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    assert module.score_documents(empty, labels_of(spark, docs).where("false")).count() == 0
    assert module.score_documents(docs, labels_of(spark, docs).where("false")).count() == len(got)


def test_filters_keep_columns(spark, docs, empty):
    none = labels_of(spark, docs).where("false")
    for f in (toxicity.without_toxic, quality.good_quality):
        assert f(docs, none).columns == docs.columns and f(docs, none).count() == docs.count() and f(empty, none).count() == 0


# 3


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block")]
    urls = ["http://a.Example.NET/en/1?x", "http://example.net/de/", "http://net/x", "http://xnet/y", "https://b.c.org/fr/", "http://example.com/de/2#t", "http://example.com", "no scheme", None, "", "http://example.net?q=/en/", "x://a.org/fr", "http://evil-example.com/de/"] * 3
    df = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def judge(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.lower(), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fit = [(h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    got = sorted(tuple(r) for r in urlrules.judge_urls(df, rules).select(F.coalesce("page_id", F.lit(0)), "host", "path", F.coalesce("rule", F.lit("")), "verdict").collect())
    assert got == sorted((i, h, p, r or "", v) for i, u in enumerate(urls) for h, p, r, v in [judge(u)])
    assert urlrules.judge_urls(df.where("false"), rules).count() == 0


def test_url_rules_by_blocks(spark, monkeypatch):
    rules = [(f"h{i % 7}.example", f"/{'p' * (i % 5)}", "block" if i % 2 else "allow") for i in range(60)]
    df = spark.createDataFrame([(i, f"http://x.h{i % 9}.example/{'p' * (i % 6)}") for i in range(200)], "page_id long, url string")
    whole = sorted(map(tuple, urlrules.judge_urls(df, rules).collect()), key=str)
    monkeypatch.setattr(urlrules, "BLOCK", 7)
    assert sorted(map(tuple, urlrules.judge_urls(df, rules).collect()), key=str) == whole


# 4 and 8


def vector_frame(spark, x, labels):
    rows = [(i, [float(v) for v in r], l, "z", 1) for i, (r, l) in enumerate(zip(x, labels, strict=True))]
    n = len(rows)
    rows += [(n, None, 1, "z", 1), (n + 1, [0.0] * x.shape[1], 1, "z", 1), (n + 2, [float("nan")] + [1.0] * (x.shape[1] - 1), 1, "z", 1), (n + 3, [None] * x.shape[1], 1, "z", 1), (n + 4, [1.0], 1, "z", 1), (n + 5, [], 1, "z", 1), (None, rows[0][1], 1, "z", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, part int").repartition(4)


def test_search_reaches_its_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:720] = x[40]  # ties
    df = vector_frame(spark, x, [1] * len(x))
    got = ann.search(df).toPandas()
    exact = x.astype(np.float64)
    hits = total = 0
    for q in range(0, len(x), 20):
        s = exact @ exact[q]
        s[q] = -np.inf
        near = np.lexsort((np.arange(len(s)), -s))[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own["vec_id"])
        assert np.allclose(own["score"], s[own["vec_id"]]) and (np.diff(own["score"]) <= 0).all()
        hits += len(set(own["vec_id"]) & set(near))
        total += 20
    assert hits / total >= 0.9
    tied = got[(got["query_id"] == 40)].sort_values("rank")["vec_id"].tolist()
    assert tied == list(range(700, 720))
    assert ann.search(df.where("false")).count() == 0
    few = ann.search(df.where("vec_id < 5")).toPandas()
    assert sorted(few["vec_id"]) == [1, 2, 3, 4]


def test_embedding_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    x[100:160] = x[5] + rng.normal(size=(60, 32)) * 0.08
    x[160:200] = x[6]
    x[200:230] = x[7] * 3
    x = x.astype(np.float32)
    labels = [None if i % 50 == 49 else i % 2 if i < 100 else 1 for i in range(400)]
    df = vector_frame(spark, x, labels)
    got = embdedup.near_duplicates(df).toPandas()
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ok = np.array([l is not None for l in labels])
    same = np.array([[a == b for b in labels] for a in labels])
    link = (unit @ unit.T >= 0.93) & same & ok[:, None] & ok[None, :] & ~np.eye(400, dtype=bool)
    root = list(range(400))
    for _ in range(12):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(400)]
    own = got[got["vec_id"] < 400].set_index("vec_id").sort_index()
    assert own["n_links"].tolist() == link.sum(1).tolist() and own["component_id"].tolist() == root
    odd = got[~(got["vec_id"] < 400)]
    assert len(odd) == 7 and (odd["n_links"] == 0).all()
    assert embdedup.near_duplicates(df.where("false")).count() == 0


def test_vectors_of_a_rarer_size_take_part(spark):
    rng = np.random.default_rng(3)
    common, rare = rng.normal(size=(300, 16)), rng.normal(size=(30, 9))
    rare[1] = 2 * rare[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(common)] + [(1000 + i, v.tolist(), 1) for i, v in enumerate(rare)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(df).collect()}
    assert got[1000]["n_links"] == 1 and got[1001]["component_id"] == 1000 and len(got) == 330
    near = ann.search(df).toPandas()
    for q in (1000, 1020):
        own = near[near["query_id"] == q].sort_values("rank")
        s = rare @ rare[q - 1000]
        s[q - 1000] = -np.inf
        assert (own["vec_id"] - 1000).tolist() == np.lexsort((np.arange(30), -s))[:20].tolist()


def test_a_query_goes_on_until_it_has_enough(spark, monkeypatch):
    monkeypatch.setattr(ann, "fit", lambda x, parts, recall: ann.Router(np.eye(16), np.zeros(16), 1))
    x = np.random.default_rng(5).normal(size=(200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert (ann.search(df).toPandas().groupby("query_id").size() == 20).all()


@pytest.mark.parametrize("rows", [1000, 1 << 21, 1 << 27])
def test_tables_keep_the_recall_with_more_axes(rows):
    plan = embdedup.plan_of(rows)
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = embdedup.codes(a, plan), embdedup.codes(b, plan)
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=(1, 2))
    assert met.mean() >= 0.97, met.mean()


def test_the_plan_is_the_same_for_every_size():
    assert len({embdedup.plan_of(n) for n in (0, 1000, 1 << 20, (1 << 20) + 1, 1 << 27)}) == 1


def test_hadamard_is_orthonormal():
    y = embdedup.hadamard(np.eye(8))
    assert np.allclose(y @ y.T, np.eye(8))


# 6


def test_ctw_bytes_sum_to_one_and_base_is_exact(spark, docs, empty):
    got = ctw.score_documents(docs).collect()
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in pairs}
    counts = Counter()
    for i, t in pairs:
        if not held[i]:
            counts.update([*WORD.findall((t or "").encode().lower()), None])
    n, v = sum(counts.values()), len(counts)
    expected = {}
    for i, t in pairs:
        w = [*WORD.findall((t or "").encode().lower()), None]
        expected.setdefault(i, (held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(got) == len(pairs)
    for r in got:
        want = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4] and abs(r["base_score"] - want[4]) < 1e-6 * abs(want[4]) and r["score"] < 0
    assert ctw.score_documents(empty).count() == 0


def test_ctw_matches_a_direct_context_tree(spark):
    data = [b"abab abba", b"abab", b"ba ab ab"]
    df = spark.createDataFrame([(d.decode(),) for d in data], "text string")
    depth = 2
    counts = ctw.corpus_counts(df).toPandas()
    strings = []
    for d in data:
        s = b"\n" * ctw.DEPTH + d + b"\n"
        strings += [s[i - ctw.DEPTH : i + 1] for i in range(ctw.DEPTH, len(s))]
    assert counts[counts["kind"] == 0]["n"].sum() == len(strings)
    nodes = ctw.tree(ctw.corpus_counts(df)).toPandas()
    kt = Counter()
    for s in strings:
        for d in range(ctw.DEPTH + 1):
            for k in range(8):
                kt[d, s[ctw.DEPTH - d : ctw.DEPTH], (1 << k) | (s[-1] >> (8 - k)), (s[-1] >> (7 - k)) & 1] += 1

    def total(context, node):
        a, b = (kt[len(context), context, node, bit] for bit in (0, 1))
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if len(context) == ctw.DEPTH:
            return own
        below = sum(total(c, node) for c in {x[1] for x in kt if x[0] == len(context) + 1 and x[2] == node and x[1][1:] == context})
        return float(np.logaddexp(own, below) - math.log(2))

    root = nodes[nodes["depth"] == 0].set_index("key")["total"]
    assert depth < ctw.DEPTH and all(abs(root[n] - total(b"", n)) < 1e-8 for n in (1, 2, 5))
    model = ctw.slot_table(ctw.tree(ctw.corpus_counts(df)))
    for context in (b"abab a", b"zzzzzz", b"\n" * 6):
        code = sum(c << (8 * (i + 1)) for i, c in enumerate(reversed(context[-ctw.DEPTH :])))
        assert abs((10 ** ctw.log10_of(code + np.arange(256, dtype=np.int64), model)).sum() - 1) < 1e-9


def test_ctw_scores_with_every_node_however_small_its_tables(spark, monkeypatch):
    rng = random.Random(6)
    many = spark.createDataFrame([(i, prose(rng, 40) + "".join(chr(rng.randrange(97, 123)) for _ in range(200))) for i in range(60)], "doc_id long, text string")
    model = ctw.slot_table(ctw.tree(ctw.corpus_counts(many.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"))))
    expected = {r["doc_id"]: ctw.log10_of(ctw.codes(*ctw.stream(ctw.Words([r["text"].encode()]))), model).sum() for r in many.collect()}
    for bits in (22, 6, 0):
        monkeypatch.setattr(ctw, "BITS", bits)
        got = {r["doc_id"]: r["score"] for r in ctw.score_documents(many).collect()}
        assert len(got) == 60 and all(abs(got[i] - expected[i]) < 1e-7 * abs(expected[i]) for i in got)


def test_ctw_contexts_reach_six_bytes_back(spark):
    df = spark.createDataFrame([("1bcdefx" * 40,), ("2bcdefy" * 40,)], "text string")
    model = ctw.slot_table(ctw.tree(ctw.corpus_counts(df)))
    for text in (b"1bcdefx", b"2bcdefy"):
        assert 10 ** ctw.log10_of(np.array([int.from_bytes(text, "big")]), model)[0] > 0.8


# 7


def test_packing_is_whole_and_tight(docs, empty):
    path = tokenizers_files.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=128).toPandas()
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    for r in got.itertuples():
        own = ids[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert len(own) > 128 or (r.piece, r.length) == (0, len(own))
        assert r.length == 128 or r.piece == 0
    assert got["length"].sum() == sum(len(ids[r["doc_id"]]) for r in docs.select("doc_id").collect())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 128
    assert packing.pack_documents(empty, path).count() == 0


def test_a_sweep_matches_like_brackets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 60):
        kind = rng.integers(0, 2, n)
        stack, docs, slots, spare = [], [], [], []
        for i, k in enumerate(kind):
            if k == 0:
                stack.append(i)
            elif stack:
                docs.append(stack.pop())
                slots.append(i)
            else:
                spare.append(i)
        got = packing.nested(kind)
        assert sorted(zip(got[0], got[1], strict=True)) == sorted(zip(docs, slots, strict=True))
        assert got[2].tolist() == spare and got[3].tolist() == stack


def best_fit(lengths, capacity):
    """The number of sequences by plain best fit, the longest first."""
    gaps, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        used += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return used


@pytest.mark.parametrize("seed", range(2))
def test_packing_needs_no_more_sequences_than_best_fit(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "RANGE", 300)
    rng, capacity = random.Random(seed), 256
    lengths = [min(capacity, 1 + int(rng.lognormvariate(3.5 + seed * 0.5, 0.8))) for _ in range(3000)] + [37] * 900 + [capacity] * 20
    df = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length int, row string").repartition(5)
    got = packing.pack(df, capacity).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(lengths))) and got.columns.tolist() == [*df.columns, "sequence_id", "offset"]
    assert (got["length"] == [lengths[i] for i in got["doc_id"]]).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= capacity
    assert got["sequence_id"].nunique() <= 1.01 * best_fit(lengths, capacity) + 1


def test_encoder_is_the_plain_one_only_for_plain_files():
    import json

    with open(tokenizers_files.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        j = json.load(f)
    assert packing.encoder(json.dumps(j).encode()).__name__ == "fast"
    j["model"]["ignore_merges"] = True
    assert packing.encoder(json.dumps(j).encode()).__name__ == "slow"


# 9


def test_sharding_is_gapless_and_moves_rows_only_into_the_new_shard(spark, docs, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(docs.select("doc_id", "text"))
    got = sharding.shard_documents(many).toPandas()
    assert len(got) == 4018 and (got["law"] == "key").all()
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert (moved["grown_shard"] == 40).all() and 40 < len(moved) < 200
    assert got["shard"].value_counts().between(50, 160).all() and got["shard"].nunique() == 40
    by_id = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    alone = sharding.shard_documents(docs).toPandas()
    of_texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.size, r.text_crc32) for r in alone.itertuples(index=False)) == of_texts
    for r in got[got["doc_id"] == 24].itertuples():
        assert r.text_crc32 in (zlib.crc32(b"t"), zlib.crc32(by_id[24].encode()))
    assert sharding.shard_documents(empty).count() == 0


def test_a_heavier_shard_only_gains(spark):
    tree = sharding.layout(40)
    heavier = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else 1.0) for s in tree]
    key = F.col("id").cast("string")
    rows = spark.range(3000).select(sharding.assign(key, tree).alias("a"), sharding.assign(key, heavier).alias("b")).toPandas()
    moved = rows[rows["a"] != rows["b"]]
    rack = {s.number: s.rack for s in tree}
    region = {s.number: s.region for s in tree}
    assert len(moved) and all(region[b] == "r0" for b in moved["b"]) and (rows["b"] == 5).sum() > 2 * (rows["a"] == 5).sum()
    assert all(rack[b] == "r0.k1" for a, b in zip(moved["a"], moved["b"], strict=True) if region[a] != "r0" and rack[b] != "r0.k0")


# 10


def test_bpe_equals_tiktoken(docs, empty, texts):
    import tiktoken

    path = tokenizers_files.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.parse_ranks(open(path, "rb").read())
    enc = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = bpe.encode_documents(docs, path, tokenizers_files.PATTERN, with_ids=True).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = enc.encode_ordinary(by_id[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_documents(empty, path, tokenizers_files.PATTERN).count() == 0


def test_short_and_long_matches_merge_alike():
    ranks = bpe.parse_ranks(open(tokenizers_files.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    tree, rng = bpe.SegmentTreeBpe(ranks), random.Random(3)
    words = list({bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rng.randrange(2, 64))) for _ in range(300)})
    many = tree.encode_many(words)
    assert all(many[w] == ([ranks[w]] if w in ranks else tree.encode_one(w)) and tree.decode(many[w]) == w for w in words)


# 11


def escaped_apart(text):
    """The escape of texts, by hand: any control string's opening bracket gets one more backslash."""
    return re.sub(r"([<\[])(\\*)(/?INST\]|/?s>|(?:IMAGE|AUDIO|DOCUMENT)\])", r"\1\\\2\3", text)


def test_chats_come_back_from_the_string(spark, empty):
    odd = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST] <\\s> <", "[/", "", None, "é日本\n[IMAGE]x", "</s", "[[INST]]<</s>>", "x" * 200_000, "\\</s>", "\n\n"]
    rng = random.Random(8)
    odd += ["".join(rng.choice(["[", "<", "\\", "INST]", "/s>", "s>", "/", "IMAGE]", "a"]) for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    rows = [(k // 6, k % 4, rng.choice(["user", "assistant", "assistant", None, "[/INST]"]), t, "x", 1) for k, t in enumerate(odd)] + [(None, None, "assistant", "z", "x", 1), (0, 0, "user", "same", "x", 1), (0, 0, "user", "same", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, string string, place int").repartition(3)
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    kept = {r["conv_id"]: r for r in formatted.collect()}
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys() == kept.keys()
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"[INST]{escaped_apart(r)}[/INST]{escaped_apart(t)}</s>" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        assert kept[c]["formatted"] == whole and kept[c]["expanded_tokens"] == 0 and kept[c]["attachments"] == []
        assert [whole[s["start"] : s["start"] + s["length"]] for s in kept[c]["loss_spans"]] == [escaped_apart(t) for *_, r, t in turns if r == "assistant"]
        assert tuple(got[c])[1:] == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    assert chat.digests(chat.format_conversations(empty.selectExpr("doc_id as conv_id", "n_chars as turn", "lang as role", "text"))).count() == 0


def test_parts_become_placeholders_with_what_they_stand_for(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return (kind, text, ref, width, height, seconds, pages)

    rows = [
        (1, 0, "user", None, [part("text", "see [IMAGE] "), part("image", ref="a.png", width=100, height=28), None, part("text", ":"), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", "ignored", [part("document", ref="c.pdf", pages=3), part("odd", "as text"), part("image", ref="d.png")]),
        (1, 2, "user", "no parts", None), (1, 3, "user", "none", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content array<{chat.PART}>")
    formatted = chat.format_conversations(df, parts="content")
    r = formatted.first()
    assert r["formatted"] == "[INST]user[/INST]see [\\IMAGE] [IMAGE]:[AUDIO]</s>[INST]assistant[/INST][DOCUMENT]as text[IMAGE]</s>[INST]user[/INST]no parts</s>[INST]user[/INST]</s>"
    assert [tuple(a) for a in r["attachments"]] == [(0, 0, "image", "a.png", 4), (0, 1, "audio", "b.wav", 38), (1, 0, "document", "c.pdf", 3072), (1, 1, "image", "d.png", 1)]
    assert r["expanded_tokens"] == 4 + 38 + 3072 + 1
    pieces = [[tuple(p) for p in t["pieces"]] for t in chat.read_turns(formatted).first()["turns"]]
    assert pieces == [[("text", "see [IMAGE] "), ("image", ""), ("text", ":"), ("audio", "")], [("document", ""), ("text", "as text"), ("image", "")], [("text", "no parts")], []]
    with pytest.raises(ValueError):
        chat.Template(others=("<a[b",))


# 12


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """k-means on integers by plain loops: rows of (vec_id, label, vector)."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    split = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for s in split:
                own.setdefault(nearest(s[p], books[p])[1], []).append(s[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    out, labels = [], Counter()
    for (i, lab, _), s in zip(kept, split, strict=True):
        found = [nearest(s[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        labels[lab] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, error, labels[lab], digest) for i, lab, code, error in out), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e4, 2e6])
def test_codes_equal_plain_loops(spark, scale):
    """With components whose distances are exact as doubles, as 64-bit integers, and only as Python's integers."""
    rng = random.Random(int(scale))
    centres = [[rng.gauss(0, 1) * scale for _ in range(8)] for _ in range(12)]
    rows = [(i, rng.choice([None, 1, 2]), [c + rng.gauss(0, 0.3 if scale == 1 else 0.01) * scale for c in rng.choice(centres)]) for i in range(700)]
    rows += [(5, 1, rows[5][2]), (None, 2, rows[9][2]), (801, 1, None), (802, 1, [1.0] * 7 + [float("nan")]), (803, 2, [float("inf")] * 8), (804, 2, [None] + [0.0] * 7), (805, None, [0.0] * 8)]
    rows += [(900 + k, 1, rows[3][2]) for k in range(200)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, code string, size int").repartition(3)
    got = sorted((tuple(r) for r in vectorcodes.compress(df, entries=40).collect()), key=str)
    assert got == plain_codes(rows, entries=40)


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 1, [0.5] * 4), (2, 1, []), (3, 1, [1.0] * 6), (4, None, [0.25] * 4)], "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: r for r in vectorcodes.compress(df).collect()}
    assert (got[1]["code"], got[4]["code"], got[2]["code"], got[3]["code"]) == ("00000000", "01010101", "00000000", None)
    assert got[3]["error"] is None and got[3]["codebooks_sha256"] is None and got[2]["error"] == 0 and got[1]["label_error"] == 0
    assert vectorcodes.compress(df.where("false")).count() == 0


def test_bounds_never_lose_the_nearest_entry():
    rng = np.random.default_rng(5)
    for w in (1, 3, 16, 24):
        entries = rng.integers(-3, 4, (60, w)) * 100
        x = rng.integers(-350, 350, (500, w))
        code, error = vectorcodes.Book(entries).nearest(x)
        every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


# 13


def plain_phrases(rows, longest=3, least=10, inside=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= inside * counts[lang, p[i : i + k]]:
                    gone.add((lang, p[i : i + k]))
    out = []
    for lang in {x for x, _ in candidates}:
        best = []
        for (of, p), a in candidates.items():
            if of == lang and (lang, p) not in gone:
                score, _, left, right = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n + 1, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest,group", [(2, 3_000_000), (3, 3_000_000), (3, 700), (4, 3_000_000)])
def test_phrases_equal_plain_counts(spark, monkeypatch, longest, group):
    monkeypatch.setattr(phrases, "GROUP", group)
    rng = random.Random(longest)
    words = ["new", "York", "city", "é", "日本", "a\x01", "a", "of", "the", "-"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    rows += [("en", "the new york city of the new york " * 40)] * 3 + [("fr", None), ("fr", ""), ("en", ".,;"), ("it", "one two")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a long, head string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest=longest, top=30).collect())
    assert got == plain_phrases(rows, longest, top=30)
    assert phrases.collocations(df.where("false")).count() == 0


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("en", " ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(200))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "sieve_of", lambda frequent: (13, b"\xff" * 1024))
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == plain_phrases(rows)


def test_only_members_that_can_still_link_are_compared(spark):
    """A bucket gives its sets to compare once, and none of a size that no other component's set can link to."""

    def row(rep, n, band, h):
        return rep, rep * 10, rep * 100, n, band, h

    members = spark.createDataFrame(
        [row(r, n, b, h) for b, h in ((3, 33), (1, 11), (2, 22)) for r, n in ((1, 30), (2, 40))]  # the same pair three times
        + [row(r, n, 4, 44) for r, n in ((1, 30), (2, 40), (3, 400), (4, 410), (5, 54))]  # 3 and 4 are connected, 5 is a class above 2
        + [row(r, n, 5, 55) for r, n in ((3, 400), (4, 410))],
        "rep long, c1 long, c2 long, n_shingles long, band int, h long",
    )
    roots = spark.createDataFrame([(4, 3)], "node long, root long")
    left = minhash.to_compare(members, roots, 75)
    assert {(r["h"], r["c1"] // 10) for r in left.collect()} == {(11, 1), (11, 2), (44, 1), (44, 2), (44, 5)}
    for percent in (50, 75, 100):  # pairs on the very edge stay, whichever way logarithms are rounded
        edge = [(k * percent, k * 100) for k in (1, 2, 7, 64, 1000)] + [(1 << k, 1 << k + 1) for k in range(12) if percent == 50]
        pairs = spark.createDataFrame([row(2 * i + j, n, 1, i) for i, pair in enumerate(edge) for j, n in enumerate(pair)], members.schema)
        assert minhash.to_compare(pairs, roots.where("false"), percent).select("c1").distinct().count() >= 2
        assert minhash.to_compare(pairs, roots.where("false"), percent).count() == 2 * len(edge)
