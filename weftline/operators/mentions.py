"""Names in texts near a keyword: a positional search for very many names at once.

A name is found as a literal part of the lower-cased text, whether or not it starts or ends within a word. Each name is
known by one of its words, the one that the fewest names have; words inside a name are whole words of the text, its last
word starts one, its first ends one, and a single word can lie anywhere in one. Only words within reach of a keyword are
looked at. They are joined with the names' words, a hit is confirmed against the text around it, and hits meet keywords
by the stretch of text they lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import is_small, stored

#: Characters before and after a name in which a keyword counts.
WINDOW = 200
#: Words that tell of a relationship, the first that is found counts.
RELATIONSHIP_WORDS = (
    "subcontract", "sub-contract", "subcontractor", "flow-down", "flowdown",
    "prime contract", "teaming agreement", "change order under", "work order under",
)
#: Names shorter than this are too common to look for.
SHORTEST = 3
#: Tasks that the places of one word are dealt to, where the words that can be a name's are too many to go to all tasks.
DEALS = 16


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _near_words(keywords: tuple[str, ...], reach: int, around: int):
    """Words within `reach` of a keyword: id, at, word, the `around` characters before and from its start, and no word but keyword for the keywords."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                if not text:
                    continue
                found = sorted((at, k) for k, w in enumerate(keywords) for at in _places(text, w))
                done = 0  # words that start before it are out already
                for at, k in found:
                    out.append((i, at, None, None, None, k))
                    start = max(done, text.rfind(" ", 0, max(0, at - reach)) + 1)
                    end = at + len(keywords[k]) + reach
                    while start < min(end, len(text)):
                        stop = text.find(" ", start)
                        stop = len(text) if stop < 0 else stop
                        if stop > start:
                            out.append((i, start, text[start:stop], text[max(0, start - around) : start], text[start : stop + around], None))
                        start = stop + 1
                    done = max(done, start)
            yield pd.DataFrame(out, columns=["id", "at", "word", "before", "after", "keyword"]).astype({"at": "int64", "keyword": "Int32"})

    return run


def anchors(names: DataFrame) -> DataFrame:
    """name, anchor, kind (alone, first, last, inside), ahead: the rarest word of each name, and how much of the name is before it."""
    names = names.select(F.lower("name").alias("name")).where(F.length("name") >= SHORTEST).distinct()
    words = names.select("name", F.split("name", " ").alias("words")).select("name", "words", F.posexplode("words").alias("k", "anchor")).where("anchor <> ''")
    often = words.groupBy("anchor").agg(F.count_distinct("name").alias("names"))
    last = F.size("words") - 1
    kind = F.when(last == 0, "alone").when(F.col("k") == 0, "first").when(F.col("k") == last, "last").otherwise("inside")
    ahead = F.length(F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")) + F.when(F.col("k") > 0, 1).otherwise(0)
    told = words.join(often, "anchor").withColumns({"kind": kind, "ahead": ahead})
    # a whole word is the better key where equally few names have it
    order = F.struct("names", F.when(F.col("kind") == "inside", 0).otherwise(1).alias("inner"), (-F.length("anchor")).alias("long"), "k")
    best = told.groupBy("name").agg(F.min_by(F.struct("anchor", "kind", "ahead"), order).alias("best"))
    return best.select("name", "best.*")


def _part(kind: str, skip: Column, anchor: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), skip.alias("skip"), anchor.alias("anchor"))


def _inner_parts(n: int) -> Column:
    """Every part of n characters of a word."""
    return F.when(F.length("word") < n, F.array().cast("array<struct<kind:string,skip:int,anchor:string>>")).otherwise(_parts_of(n))


def _parts_of(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length("word") - n), lambda p: _part("alone", p, F.col("word").substr(p + 1, F.lit(n))))


def find(texts: DataFrame, names: DataFrame, keywords: tuple[str, ...] = RELATIONSHIP_WORDS, window: int = WINDOW) -> DataFrame:
    """id, name, keyword, at of every name with a keyword near: (id, text) and (name) rows; texts and names are lower-cased.

    One row for each id and name: its first place with a keyword that lies wholly within `window` characters before and
    after it, and of the keywords there the first in their order. Null and empty texts have none, names under three
    characters aren't looked for. The longest name decides how much text goes with a word.
    """
    keyed = anchors(names)
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    sizes = [r[0] for r in keyed.where("kind = 'alone'").select(F.length("anchor")).distinct().collect()]  # at most as many as the longest name has characters
    reach = window + longest
    low = texts.select("id", F.lower("text").alias("text"))
    near = low.mapInPandas(_near_words(keywords, reach, longest), f"id {dict(texts.dtypes)['id']}, at long, word string, before string, after string, keyword int")
    near = stored(near, "near-words")
    words = near.where("word is not null").select("id", "at", "word", "before", "after")

    # the parts of each different word that may be a name's word, by where a name's word of that kind can lie
    ends = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda p: _part("first", p, F.col("word").substr(p + 1, F.length("word"))))
    starts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: _part("last", F.lit(0), F.col("word").substr(F.lit(1), n)))
    parts = F.concat(F.array(_part("inside", F.lit(0), F.col("word"))), ends, starts, *(_inner_parts(n) for n in sizes))
    parts = words.select("word").distinct().select("word", F.explode(parts).alias("p"))
    of_word = stored(parts.select("word", "p.*").join(keyed, ["kind", "anchor"]).select("word", "skip", "ahead", "name"), "word-names")

    if is_small(of_word):  # the words stay where they are
        hits = words.join(F.broadcast(of_word), "word")
    else:
        deals = F.sequence(F.lit(0), F.lit(DEALS - 1))
        hits = words.withColumn("deal", F.pmod(F.xxhash64("id", "at"), F.lit(DEALS)).cast("int")).join(of_word.withColumn("deal", F.explode(deals)), ["word", "deal"])
    spot = F.length("before") + F.col("skip") - F.col("ahead")
    hits = hits.where((spot >= 0) & (F.concat("before", "after").substr(spot + 1, F.length("name")) == F.col("name")))
    hits = hits.select("id", "name", (F.col("at") + F.col("skip") - F.col("ahead")).alias("at")).distinct()

    order = F.create_map(*(x for k, w in enumerate(keywords) for x in (F.lit(k), F.lit(w))))
    spoken = near.where("keyword is not null").select("id", F.col("at").alias("spoken"), "keyword", F.length(order[F.col("keyword")]).alias("size"))
    stretch = 2 * window + longest + max(map(len, keywords))
    spoken = spoken.withColumn("stretch", F.floor(F.col("spoken") / stretch))
    hits = hits.withColumn("stretch", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / stretch) + d)))
    close = (F.col("spoken") >= F.col("at") - window) & (F.col("spoken") + F.col("size") <= F.col("at") + F.length("name") + window)
    both = hits.join(spoken, ["id", "stretch"]).where(close)
    first = both.groupBy("id", "name").agg(F.min(F.struct("at", "keyword")).alias("first"))
    return first.select("id", "name", order[F.col("first.keyword")].alias("keyword"), F.col("first.at").alias("at"))
