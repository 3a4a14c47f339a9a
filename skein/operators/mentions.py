"""NL-4 to 6: mentions of known values in query texts, explicit and implicit, and their choice.

Places are counted from 0 in the text as it stands, ends exclusive: accents and letter
case are folded one to one, so nothing shifts. A mention is bounded by other characters than
a-z and 0-9. Phrases without any of these can't be looked up and are left out. Null and
empty texts have no mentions. Value places behind a label are true ones, and words such as
"de" are skipped there as whole words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import ACCENTED, PLAIN, normalize_text

#: Characters behind a label in which its value is looked for.
REACH = 80
# Words between a label and its value, and words that are no value by themselves.
_SKIPPED = r"^(?:[\s:\-]|(?:de|del|la|el|con|en)(?![a-z0-9]))+"
_NO_VALUE = ["de", "del", "la", "el", "con", "en", "para", "tipo"]


def folded(c: Column) -> Column:
    """A text without accents and in lower case, of the same length."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def places(text: Column, phrase: Column) -> Column:
    """All starts (from 0) of a phrase in a folded text, as whole words. Only texts that
    contain the phrase are looked through place by place."""
    padded, size = F.concat(F.lit(" "), text, F.lit(" ")), F.length(phrase)
    letter = lambda at: F.substring(padded, at, F.lit(1)).rlike("[a-z0-9]")
    fits = lambda i: (F.substring(text, i, size) == phrase) & ~letter(i) & ~letter(i + size + 1)
    last = F.length(text) - size + 1
    return F.when((last > 0) & F.contains(text, phrase), F.transform(F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), fits), lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def phrase_places(queries: DataFrame, phrases: DataFrame, by: list[str]) -> DataFrame:
    """NL-4: every place of every phrase in the texts of its own ``by``: the columns of
    phrases (with its normal form) with query_id, start and stop.

    Met by the phrase's word that the fewest texts hold; a phrase with a word that none holds
    goes at once. queries: query_id, text; phrases: phrase; both with the columns of ``by``."""
    split = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))
    asked = queries.select(*by, "query_id", folded(F.col("text")).alias("_text"))
    words = asked.select(*by, "query_id", "_text", F.explode(split(F.col("_text"))).alias("_word"))
    counts = words.groupBy(*by, "_word").agg(F.count("*").alias("_n"))
    known = phrases.withColumn("phrase", normalize_text(F.col("phrase"))).where("phrase <> ''")
    own = known.select(*by, "phrase").distinct().select(*by, "phrase", F.explode(split(F.col("phrase"))).alias("_word"))
    keys = own.join(counts.hint("merge"), [*by, "_word"], "left").groupBy(*by, "phrase").agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"), F.bool_and(F.col("_n").isNotNull()).alias("_all"))
    met = words.join(keys.where("_all").drop("_all").hint("merge"), [*by, "_word"])  # the words of all texts are never broadcast
    found = met.select(*by, "query_id", "phrase", F.explode(places(F.col("_text"), F.col("phrase"))).alias("start"))
    return found.join(known.hint("merge"), [*by, "phrase"]).withColumn("stop", F.col("start") + F.length("phrase"))


def implicit_links(queries: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """NL-4: (query_id, field, value, start, stop, length, explicit): of each value that is
    mentioned, by itself or an alias, the longest mention, at its first place.
    values: by, field, value, phrase (the value itself, or an alias)."""
    found = phrase_places(queries, values, by)
    best = F.max(F.struct((F.col("stop") - F.col("start")).alias("length"), (-F.col("start")).alias("s"))).alias("b")
    rows = found.groupBy("query_id", "field", "value").agg(best)
    return rows.select("query_id", "field", "value", (-F.col("b.s")).alias("start"), (F.col("b.length") - F.col("b.s")).alias("stop"), F.col("b.length").alias("length"), F.lit(False).alias("explicit"))


def _apart(spans: Column) -> Column:
    """Of spans (start, stop) in order those that overlap none taken before."""
    none = F.slice(spans, 1, 0)
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    return F.aggregate(spans, none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))


def explicit_links(queries: DataFrame, hints: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """NL-5: links as in implicit_links, of values behind a label of their field (by, field,
    phrase): the longest of the value's own mentions, of the number that it begins with
    (two characters or more), or of the up to three words behind the label when the value
    contains them and they hold a letter. A field without any values takes these words.

    The labels of a field are tried from the longest, at their first place, if they don't
    overlap one before. Equal lengths go to the smaller value."""
    spots = phrase_places(queries, hints.where(F.length("phrase") > 1), by)
    first = spots.groupBy(*by, "query_id", "field", "phrase").agg(F.min(F.struct("start", "stop")).alias("s"))
    order = F.sort_array(F.collect_list(F.struct((-F.length("phrase")).alias("size"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))))
    spans = first.groupBy(*by, "query_id", "field").agg(order.alias("o")).select(*by, "query_id", "field", F.explode(_apart(F.col("o"))).alias("h"))
    rows = spans.join(queries.select("query_id", folded(F.col("text")).alias("_text")).hint("merge"), "query_id")
    rows = rows.select(*by, "query_id", "field", F.col("h.start").alias("from"), F.col("h.stop").alias("to"), F.substring("_text", F.col("h.stop") + 1, F.lit(REACH)).alias("raw"))
    rows = rows.withColumn("tail", F.regexp_replace("raw", _SKIPPED, "")).withColumn("at", F.col("to") + F.length("raw") - F.length("tail")).where("tail <> ''")
    said = F.slice(F.filter(F.regexp_extract_all("tail", F.lit("[a-z0-9%.,]+"), F.lit(0)), lambda w: ~w.isin(_NO_VALUE)), 1, 3)
    rows = rows.withColumn("said", F.array_join(said, " "))
    phrase, value = normalize_text(F.col("phrase")), normalize_text(F.col("value"))
    number = F.regexp_extract(phrase, r"^[0-9]+(?:[.,][0-9]+)?", 0)
    met = rows.join(values.select(*by, "field", "value", "phrase"), [*by, "field"])
    place = lambda p: F.get(places(F.col("tail"), p), 0)
    met = met.withColumns({"whole": place(phrase), "part": F.when(F.length(number) >= 2, place(number))})
    partial = (F.col("said").rlike("[a-z]")) & F.contains(value, F.col("said"))
    token = F.when(F.col("whole").isNotNull(), phrase).when(F.col("part").isNotNull(), number)
    own = F.struct(F.lit(1).alias("own"), F.length(token).alias("length"), F.coalesce("whole", "part").alias("place"))
    rest = F.struct(F.lit(0).alias("own"), F.length("said").alias("length"), F.coalesce(place(F.col("said")), F.lit(0)).alias("place"))
    met = met.withColumn("m", F.when(token.isNotNull(), own).when(partial, rest)).where("m is not null")
    # the value's own mentions come before the words that it contains
    each = met.groupBy("query_id", "field", "from", "to", "at", "value").agg(F.max("m").alias("m"))
    best = each.groupBy("query_id", "field", "from", "to", "at").agg(F.min_by(F.struct("value", "m.length", "m.place"), F.struct(-F.col("m.length"), F.col("value"))).alias("b"))
    known = best.select("query_id", "field", "b.value", "from", "to", (F.col("at") + F.col("b.place")).alias("begin"), F.col("b.length").alias("length"))
    bare = rows.join(values.select(*by, "field").distinct(), [*by, "field"], "left_anti")
    word = F.regexp_extract("tail", r"[a-z0-9][a-z0-9%.,]*(?:\s+[a-z0-9%.,]+){0,2}", 0)
    bare = bare.withColumn("value", word).where("value <> ''").select("query_id", "field", "value", "from", "to", (F.col("at") + F.instr(F.col("tail"), F.col("value")) - 1).alias("begin"), F.length("value").alias("length"))
    rows = known.unionByName(bare)
    return rows.select("query_id", "field", "value", F.least("from", "begin").alias("start"), F.greatest("to", F.col("begin") + F.col("length")).alias("stop"), "length", F.lit(True).alias("explicit"))


def choose_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NL-6: (links that hold, ambiguous links). Explicit links from the longest, one a field,
    none over another; then the implicit ones of other fields that overlap none of these.
    Implicit links of several fields with one span and value are ambiguous and hold for none.
    Equal lengths go to the smaller field, then start. A query's explicit links are a few."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("size"), "field", "start", "stop", "value", "length")))
    rows = links.where("explicit").groupBy("query_id").agg(order.alias("o"))
    none = F.slice("o", 1, 0)
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["field"] == x["field"]) | (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    taken = rows.select("query_id", F.aggregate("o", none, lambda t, x: F.when(free(t, x), F.concat(t, F.array(x))).otherwise(t)).alias("taken"))
    firm = taken.select("query_id", F.explode("taken").alias("x")).select("query_id", "x.field", "x.value", "x.start", "x.stop", "x.length", F.lit(True).alias("explicit"))
    open_ = links.where("not explicit").join(taken.hint("merge"), "query_id", "left").where(F.expr("taken is null or not exists(taken, y -> y.field = field or (y.start < stop and start < y.stop))")).drop("taken")
    claims = open_.groupBy("query_id", "start", "stop", normalize_text(F.col("value")).alias("_v")).agg(F.count_distinct("field").alias("_fields"))
    marked = open_.withColumn("_v", normalize_text(F.col("value"))).join(claims.hint("merge"), ["query_id", "start", "stop", "_v"])
    columns = ["query_id", "field", "value", "start", "stop", "length", "explicit"]
    return firm.select(columns).unionByName(marked.where("_fields = 1").select(columns)), marked.where("_fields > 1").select(columns)
