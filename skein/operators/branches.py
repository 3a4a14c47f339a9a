"""LEX: parts of a query text, synonyms, and searches over several parts at once.

Null and empty texts give no parts. Rows may repeat: parts are distinct per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import normalize_identifier, normalize_text
from skein.operators.rank import rrf
from skein.operators.search import lexical_match, topk

# The pattern of a labelled code.
LABELLED = r"(?i)(?:\b(?:sku|c[oó]digo|code|referencia|ref|parte|part(?:\s+number)?|item)\b|p\s*/\s*n)\s*[#:=-]?\s*([a-z0-9][a-z0-9._/-]{1,31})"
# Words that join others, and words of intent; neither tells records apart.
CONNECTORS = (
    "a al con de del el en la las los o ó or para por un una unos unas y e que se su sus mi mis tu tus como mas más muy sin sobre tipo the and for"
).split()
INTENT = (
    "tela telas producto productos manualidades manualidad bordar bordado punto cruz costura confeccion confección disponible disponibles buscar"
    " necesito quiero tienen hay"
).split()
# The weight of each kind of part.
WEIGHTS = {"full": 1.0, "phrase": 1.15, "synonym": 1.25, "distinctive": 1.5}
OR = r"(?i)\s+(?:o|ó|or)\s+"


def query_terms(queries: DataFrame) -> DataFrame:
    """LEX-2: (query_id, alt, kind, term): alternatives around ``or``; "phrases", -excluded words and words."""
    alts = queries.select("query_id", F.posexplode(F.split(normalize_text(F.col("text")), r"\s+or\s+")).alias("alt", "part"))
    rows = alts.select("query_id", "alt", F.explode(F.regexp_extract_all("part", F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))).alias("raw"))
    kind = F.when(F.col("raw").startswith("-"), "excluded").when(F.col("raw").startswith('"'), "phrase").otherwise("word")
    term = F.trim(F.replace(F.regexp_replace("raw", "^-", ""), F.lit('"')))
    return rows.select("query_id", "alt", kind.alias("kind"), term.alias("term")).where("term <> ''").distinct()


def explicit_identifier(c: Column) -> Column:
    """LEX-8: the whole text if it is a short code with a digit, else a labelled code; null if neither has 3 characters."""
    whole = F.trim(c)
    short = whole.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,31}$") & whole.rlike("[0-9]") & (F.length(normalize_identifier(whole)) >= 3)
    labelled = F.regexp_extract(whole, LABELLED, 1)
    found = F.when(short, whole).otherwise(F.regexp_replace(labelled, "[.,;:]+$", ""))
    return F.when(F.length(normalize_identifier(found)) >= 3, found)


def prepend_identifiers(codes: DataFrame, hits: DataFrame, n: int = 50) -> DataFrame:
    """LEX-10: codes (query_id, id) before hits (query_id, id, place), each id once, n of a query at most."""
    both = codes.select("query_id", "id", F.lit(0).alias("tier"), F.lit(0).alias("place")).unionByName(hits.select("query_id", "id", F.lit(1).alias("tier"), "place"))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("tier", "place")).alias("b"))
    return topk(best, ["b.tier", "b.place", "id"], n).select("query_id", "id", (F.col("b.tier") == 0).alias("identifier"), "place")


def branches(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """LEX-11: (query_id, text, kind, weight) from queries (query_id, text) and synonyms (term, synonym).

    Of parts with one normal form the heaviest stays (then the least text). A term of
    the vocabulary applies where the text contains it; the join runs on the term's
    first three characters against the substrings of that length of each distinct text.
    These are many more rows than their files let Spark guess, so they are never broadcast.
    """
    q = queries.select("query_id", F.trim("text").alias("text"))
    segments = q.select("query_id", normalize_text(F.col("text")).alias("whole"), F.explode(F.transform(F.split("text", r"[,;|/]+"), lambda x: F.trim(x))).alias("text"))
    phrases = segments.where(normalize_text(F.col("text")) != F.col("whole"))
    pieces = lambda rows: rows.where(F.col("text").rlike(OR)).select("query_id", F.explode(F.split("text", OR)).alias("text"))
    token = q.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\p{L}[\p{L}\p{N}'-]*"), F.lit(0))).alias("text"))
    norm = normalize_text(F.col("text"))
    telling = ~norm.isin(CONNECTORS + INTENT) & (F.length(norm) >= F.when(F.col("text").rlike(r"^\p{Lu}"), 3).otherwise(5))

    grams = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.transform(F.sequence(F.lit(1), F.length("norm")), lambda i: F.substring("norm", i, k))))
    asked = q.select("query_id", normalize_text(F.col("text")).alias("norm")).where("norm <> ''")
    keys = asked.select("norm").distinct().select("norm", F.explode(F.array_distinct(grams)).alias("k"))
    terms = synonyms.select(normalize_text(F.col("term")).alias("term"), "synonym").where("term <> ''").withColumn("k", F.substring("term", 1, 3))
    met = keys.join(terms.hint("merge"), "k").where(F.contains("norm", "term")).select("norm", "synonym").distinct()
    known = asked.join(met.hint("merge"), "norm").select("query_id", F.col("synonym").alias("text"))

    kinds = {"full": [q], "phrase": [phrases.select("query_id", "text")], "synonym": [known], "distinctive": [pieces(segments), pieces(q), token.where(telling)]}
    out = None
    for kind, parts in kinds.items():
        for part in parts:
            part = part.select("query_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).alias("weight"))
            out = part if out is None else out.unionByName(part)
    best = out.withColumn("norm", norm).where("norm <> ''").groupBy("query_id", "norm").agg(F.min(F.struct((-F.col("weight")).alias("w"), "text", "kind")).alias("b"))
    return best.select("query_id", "b.text", "b.kind", (-F.col("b.w")).alias("weight"))


def _synonym_order(c: Column) -> Column:
    """Codes of letters and digits first, then digits, then others with a digit; volumes last."""
    t = normalize_identifier(c)
    volume = t.rlike("^[0-9]+(l|lt|lts|litro|litros|t)$")
    return F.when(volume, 0).when(t.rlike("[a-z]") & t.rlike("[0-9]"), 3).when(t.rlike("^[0-9]+$"), 2).when(t.rlike("[0-9]"), 1).otherwise(0)


def select_branches(parts: DataFrame, most: int = 6, synonyms: int = 3) -> DataFrame:
    """LEX-12: the full text, some synonyms, and the heaviest others, ``most`` in all."""
    kind = F.when(F.col("kind").isin("full", "synonym"), F.col("kind")).otherwise("other")
    rows = parts.withColumn("c", kind).withColumn("p", F.when(F.col("c") == "synonym", _synonym_order(F.col("text"))).otherwise(0))
    own, all_ = Window.partitionBy("query_id", "c").orderBy(F.desc("p"), F.desc("weight"), "text"), Window.partitionBy("query_id")
    rows = rows.withColumn("r", F.row_number().over(own)).withColumn("n", F.count("*").over(all_))
    rows = rows.withColumn("full", F.count_if(F.col("c") == "full").over(all_)).withColumn("syn", F.count_if(F.col("c") == "synonym").over(all_))
    taken = F.least(F.lit(synonyms), most - F.col("full"))
    room = F.when(F.col("c") == "full", F.col("full")).when(F.col("c") == "synonym", taken).otherwise(most - F.col("full") - F.least(taken, "syn"))
    return rows.where((F.col("n") <= most) | (F.col("r") <= room)).select("query_id", "text", "kind", "weight")


def lexical_multi(parts: DataFrame, index: DataFrame, n: int = 50) -> DataFrame:
    """LEX-13: the n best hits of each part, fused by rank with the parts' weights. A text that
    several queries share is searched once."""
    each = parts.select(F.col("text").alias("query_id"), "text").where("text is not null").distinct()
    hits = topk(lexical_match(index, each), [F.desc("rank"), "id"], n).select(F.col("query_id").alias("text"), "id", "place")
    ranked = hits.join(parts.select("query_id", "text", "weight").hint("merge"), "text")
    return rrf(ranked.select("query_id", "id", F.col("place").alias("rank"), "weight")).where(F.col("place") <= n)


def effective_synonyms(mappings: DataFrame, policies: DataFrame) -> DataFrame:
    """LEX-14: (entity, term, synonyms) from (source, entity, term, synonym): a source's policy replaces its
    mapping entries; several sources are merged, without repeats, sorted."""
    own = mappings.join(policies.select("source", "entity").distinct(), ["source", "entity"], "left_anti")
    rows = own.unionByName(policies).where("term is not null and synonym is not null")
    return rows.groupBy("entity", "term").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def distinctive_coverage(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """LEX-15: share of a query's distinctive parts that a hit's text contains; 1 without such parts, 0 without text."""
    terms = parts.where("kind in ('distinctive', 'synonym')").groupBy("query_id").agg(F.collect_set(normalize_text(F.col("text"))).alias("terms"))
    rows = hits.join(terms.hint("merge"), "query_id", "left").withColumn("norm", normalize_text(F.coalesce("text", F.lit(""))))
    share = F.size(F.filter("terms", lambda x: F.contains(F.col("norm"), x))) / F.size("terms")
    return rows.select("query_id", "id", F.round(F.when(F.col("terms").isNull(), 1.0).otherwise(share), 6).alias("coverage"))


def synonym_violations(vocabulary: DataFrame, most: int = 50, length: int = 100) -> DataFrame:
    """LEX-16: (term, reason) of a vocabulary (term, synonym): spellings of one term, synonyms equal to their term
    or to each other, more than ``most`` synonyms, texts over ``length``."""
    v = vocabulary.select("term", "synonym", normalize_text(F.col("term")).alias("t"), normalize_text(F.col("synonym")).alias("s"))
    spellings = v.groupBy("t").agg(F.collect_set("term").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("term"), F.lit("duplicate term").alias("reason"))
    per = v.groupBy("term").agg(
        F.count_if(F.col("s") == F.col("t")).alias("self"), (F.count("s") > F.countDistinct("s")).alias("twice"), F.count("s").alias("n"),
        F.max(F.greatest(F.length("term"), F.length("synonym"))).alias("longest"),
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("self") > 0, F.lit("self synonym")), F.when(F.col("twice"), F.lit("duplicate synonym")),
        F.when(F.col("n") > most, F.lit("too many synonyms")), F.when(F.col("longest") > length, F.lit("too long"))))
    return spellings.unionByName(per.select("term", F.explode(reasons).alias("reason")))
