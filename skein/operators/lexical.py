"""LEX-1 to 4 with places: an index of stems with positions and tiers, and ranks by covers.

A tier's words come behind those of the tiers before it. A record whose tiers are all empty is
indexed by its fallback text. Null texts are empty; a query without lexemes matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.stem import placed_words, stemmed

# What a tier counts in a cover; the fallback text counts as D.
TIERS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def postings(records: DataFrame, id_col: str, tiers: dict[str, str], fallback: str | None = None) -> DataFrame:
    """LEX-1: (token, id, hits): the places of each lexeme of a record, as (pos, weight).
    tiers: column -> A to D, in the order in which their texts follow each other. Store it: a
    search reads it several times. A record is as large as its own words at any time, whatever
    the number of records: words become stems when each is a row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    empty = F.lit(True)
    for c in tiers:
        empty = empty & (F.trim(text(c)) == "")
    parts = [(text(c), w) for c, w in tiers.items()]
    if fallback:
        parts.append((F.when(empty, text(fallback)).otherwise(""), "D"))
    rows = records.select(F.col(id_col).alias("id"), *(placed_words(t).alias(f"_{k}") for k, (t, _) in enumerate(parts)))
    shift, lines = F.lit(0), []  # the last place of the tiers before
    for k, (_, tier) in enumerate(parts):
        lines.append(F.struct(F.col(f"_{k}").alias("words"), shift.alias("shift"), F.lit(TIERS[tier]).alias("weight")))
        shift = shift + F.coalesce(F.get(F.col(f"_{k}"), F.size(f"_{k}") - 1)["pos"], F.lit(0))
    line = rows.select("id", F.inline(F.array(*lines)))  # a row a tier
    words = line.select("id", "shift", "weight", F.explode("words").alias("x"))
    words = words.select("id", stemmed(F.col("x.word")).alias("token"), F.struct((F.col("x.pos") + F.col("shift")).alias("pos"), "weight").alias("hit"))
    return words.groupBy("token", "id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))


def query_lexemes(terms: DataFrame) -> DataFrame:
    """(query_id, alt, kind, term, off, token) of LEX-2's terms; stop words keep their places in a phrase."""
    rows = terms.select("query_id", "alt", "kind", "term", F.explode(placed_words(F.col("term"))).alias("x"))
    return rows.select("query_id", "alt", "kind", "term", F.col("x.pos").alias("off"), stemmed(F.col("x.word")).alias("token"))


def cover_search(index: DataFrame, terms: DataFrame) -> DataFrame:
    """LEX-3, 4: (query_id, id, rank) of records that satisfy a query's terms (query_id, alt,
    kind, term): all words and phrases of some alternative, none of its excluded terms.

    Records are first found by each alternative's rarest lexeme, and only these pairs look
    the other lexemes up. The rank is the sum over all covers, the shortest stretches that
    satisfy an alternative: with n places of query words in a cover, n / sum(1 / weight),
    divided by one more than its words that no query word holds."""
    words = query_lexemes(terms).distinct()
    need = words.where("kind <> 'excluded'").select("query_id", "alt", "token").distinct()
    counts = index.join(need.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = need.join(counts, "token", "left").groupBy("query_id", "alt").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.count("*").alias("needed"))
    found = rarest.join(index.select("token", "id"), "token").select("query_id", "alt", "needed", "id")
    held = found.join(need, ["query_id", "alt"]).join(index.select("token", "id"), ["token", "id"])
    full = held.groupBy("query_id", "alt", "id", "needed").agg(F.count("*").alias("n")).where("n = needed").select("query_id", "alt", "id")
    full = _with_phrases(full, words.where("kind = 'phrase'"), index, True)
    full = _with_phrases(full, words.where("kind = 'excluded'"), index, False)
    alts = need.groupBy("query_id", "alt").agg(F.sort_array(F.collect_list("token")).alias("alt_tokens")).groupBy("query_id").agg(F.collect_list("alt_tokens").alias("alts"))
    pairs = full.select("query_id", "id").distinct()
    tokens = need.select("query_id", "token").distinct()
    events = pairs.join(tokens, "query_id").join(index, ["token", "id"]).select("query_id", "id", F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), F.col("token").alias("token"), (1 / h["weight"]).alias("inverse"))).alias("e"))
    rows = events.groupBy("query_id", "id").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    return rows.join(alts, "query_id").select("query_id", "id", cover_density(F.col("e"), F.col("alts")).alias("rank"))


def _with_phrases(full: DataFrame, words: DataFrame, index: DataFrame, wanted: bool) -> DataFrame:
    """The (query_id, alt, id) that hold all wanted phrases, or none of the unwanted ones: the
    lexemes of a phrase at the same distances as in the query."""
    met = full.join(words, ["query_id", "alt"]).join(index, ["token", "id"])
    starts = met.select("query_id", "alt", "id", "term", "off", F.explode(F.transform("hits", lambda h: h["pos"])).alias("pos"))
    sizes = words.groupBy("query_id", "alt", "term").agg(F.count("*").alias("size"))
    lines = starts.groupBy("query_id", "alt", "id", "term", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n"))
    there = lines.join(sizes, ["query_id", "alt", "term"]).where("n = size").select("query_id", "alt", "id", "term").distinct()
    if not wanted:
        return full.join(there, ["query_id", "alt", "id"], "left_anti")
    some = there.groupBy("query_id", "alt", "id").agg(F.count("*").alias("there"))
    asked = sizes.groupBy("query_id", "alt").agg(F.count("*").alias("asked"))
    return full.join(asked, ["query_id", "alt"], "left").join(some, ["query_id", "alt", "id"], "left").where("coalesce(there, 0) = coalesce(asked, 0)").select("query_id", "alt", "id")


def cover_density(events: Column, alts: Column) -> Column:
    """Of the places (pos, token, inverse weight) in order and the alternatives (arrays of
    tokens): one sweep that keeps each token's last place. A place closes a cover where the
    latest start that satisfies an alternative has moved on."""
    def let(value: Column, then) -> Column:
        """then(value), which is worked out once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def start_of(last: Column) -> Column:
        return F.array_max(F.transform(alts, lambda alt: F.array_min(F.transform(alt, lambda t: F.coalesce(last[t], F.lit(0))))))

    def cover(start: Column, at: Column, event: Column) -> Column:
        size = at - start + 1
        noise = event["pos"] - F.element_at(events, start)["pos"] - (size - 1)
        inverse = F.aggregate(F.slice(events, start, size), F.lit(0.0), lambda s, e: s + e["inverse"])
        return size / inverse / (1 + noise)

    def step(state: Column, at: Column) -> Column:
        def moved(last: Column, event: Column) -> Column:
            return let(
                start_of(last),
                lambda start: F.struct(
                    last.alias("last"), F.greatest(start, state["start"]).alias("start"),
                    (state["rank"] + F.when(start > state["start"], cover(start, at, event)).otherwise(F.lit(0.0))).alias("rank"),
                ),
            )

        def seen(event: Column) -> Column:
            others = F.map_filter(state["last"], lambda k, _: k != event["token"])
            return let(F.map_concat(others, F.map_from_arrays(F.array(event["token"]), F.array(at))), lambda last: moved(last, event))

        return let(F.element_at(events, at), seen)

    begin = F.struct(F.expr("cast(map() as map<string, int>)").alias("last"), F.lit(0).alias("start"), F.lit(0.0).alias("rank"))
    return F.round(F.aggregate(F.sequence(F.lit(1), F.size(events)), begin, step, lambda s: s["rank"]), 6)
