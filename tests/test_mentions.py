"""Mentions, stems and covers on small texts and odd rows."""

import pytest
from pyspark.sql import functions as F

from skein.functions.stem import stem
from skein.operators import extract, lexical, mentions, search
from skein.operators.branches import query_terms

TEXTS = [
    (1, "e", "camiseta roja color rojo"), (2, "e", "vestido rojo talla M"), (3, "e", "tela ancho 1.50"), (4, "e", "Máximo 1.500 en stock, color de la Arena"),
    (5, "e", "ropa azul azul color"), (6, "e", None), (7, "e", "marca nadie sabe esto largo"), (8, "e", "color verde ol"), (9, "e", ""), (10, "e", "diafragma color 30"), (11, "other", "color rojo"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "query_id int, entity string, text string")


@pytest.fixture(scope="module")
def known(spark):
    hints = [("e", f, p) for f, p in (("color", "color"), ("size", "talla"), ("width", "ancho"), ("brand", "marca"))]
    values = [("color", "rojo", "rojo"), ("color", "azul", "azul"), ("color", "verde oliva", "verde oliva"), ("color", "beige", "arena"), ("color", "DT530 30", "DT530 30"), ("size", "M", "M"), ("width", "1.50m", "1.50m"), ("shade", "azul", "azul")]
    make = spark.createDataFrame
    return make(hints, "entity string, field string, phrase string"), make([("e", *v) for v in values], "entity string, field string, value string, phrase string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_explicit(texts, known):
    hints, values = known
    assert rows(mentions.explicit_links(texts, hints, values, ["entity"]).drop("explicit")) == [
        (1, "color", "rojo", 14, 24, 4), (2, "size", "M", 13, 20, 1), (3, "width", "1.50m", 5, 15, 4), (4, "color", "beige", 23, 40, 5),
        (7, "brand", "nadie sabe esto", 0, 21, 15), (8, "color", "verde oliva", 0, 14, 8),
    ]


def test_every_place_and_choice(texts, known):
    hints, values = known
    assert rows(mentions.phrase_places(texts, values.where("value = 'azul' and field = 'color'"), ["entity"]).select("query_id", "start", "stop")) == [(5, 5, 9), (5, 10, 14)]
    both = mentions.explicit_links(texts, hints, values, ["entity"]).unionByName(mentions.implicit_links(texts, values, ["entity"]))
    kept, ambiguous = mentions.choose_links(both)
    got = rows(kept.select("query_id", "field", "explicit"))
    assert got == [(1, "color", True), (2, "color", False), (2, "size", True), (3, "width", True), (4, "color", True), (7, "brand", True), (8, "color", True)]
    assert rows(ambiguous.select("query_id", "field")) == [(5, "color"), (5, "shade")]
    left = dict(rows(extract.residual_text(texts.select("query_id", "text"), kept)))
    assert left[1] == "camiseta roja" and left[4] == "Máximo 1.500 en stock," and left[5] == "ropa azul azul color" and left[6] == "" and left[10] == "diafragma color 30"


def test_explicit_links_of_one_text_never_overlap(spark):
    links = [(1, "a", "x", 0, 9, 5, True), (1, "a", "y", 20, 29, 7, True), (1, "b", "z", 25, 40, 6, True), (1, "c", "w", 10, 15, 3, True), (1, "d", "v", 12, 14, 2, False), (1, "d", "u", 50, 52, 2, False)]
    kept, _ = mentions.choose_links(spark.createDataFrame(links, "query_id int, field string, value string, start int, stop int, length int, explicit boolean"))
    assert rows(kept.select("field", "value")) == [("a", "y"), ("c", "w"), ("d", "u")]


def test_spans_of_ranges_and_joined_rest(spark, texts):
    assert rows(extract.range_links(texts)) == [(4, "lte", 1500.0, 0, 12)]
    one = spark.createDataFrame([(1, "ab[cd]ef"), (2, "  a   b ")], "query_id int, text string")
    spans = spark.createDataFrame([(1, 2, 6), (1, 3, 5)], "query_id int, start int, stop int")
    assert rows(extract.residual_text(one, spans)) == [(1, "abef"), (2, "a   b")]


def test_unknown_behaviour_filters(spark):
    links = spark.createDataFrame([(1, "f", False)], "query_id int, field string, explicit boolean")
    none = spark.createDataFrame([], "field string, behaviour string, boost double")
    assert extract.route_links(links, none, none).first().behaviour == "filter"


def test_stems():
    assert len({stem(w) for w in ("tela", "telas")}) == 1 and len({stem(w) for w in ("negra", "negras", "negro", "negros")}) == 1
    for word, wanted in {"rapidamente": "rapid", "organizaciones": "organiz", "comprandolo": "compr", "soluciones": "solucion", "diferencia": "diferent", "construyendo": "constru", "pague": "pag", "de": "de", "a": "a", "": "", "dt530": "dt530"}.items():
        assert stem(word) == wanted, word


def test_covers(spark):
    """Two covers of (a b): places 1-2, and 2-5 with two words between; the tiers weigh 1 and 0.1."""
    records = spark.createDataFrame([(1, "alfa beta", "x x alfa"), (2, "", None), (3, "alfa", "")], "id int, name string, more string")
    fallback = records.selectExpr("*", "'telas beta' as whole")
    index = lexical.postings(fallback, "id", {"name": "A", "more": "D"}, "whole")
    terms = query_terms(spark.createDataFrame([(1, "beta alfa"), (2, "tela"), (3, '"alfa beta"'), (4, '"beta alfa"'), (5, "alfa -beta"), (6, "de la"), (7, None)], "query_id int, text string"))
    got = {(q, i): r for q, i, r in rows(lexical.cover_search(index, terms))}
    assert got == {(1, 1): round(2 / 2 + 2 / 11 / 3, 6), (2, 2): 0.1, (3, 1): pytest.approx(got[(3, 1)]), (5, 3): 1.0}


def test_trigram_prefixes_lose_no_pair(spark):
    """Against all pairs: texts that share a common piece, equal ones, empty and null ones."""
    names = ["dt-530", "dt-531", "dt530", "common part one", "common part two", "common", "zz9", "zz9", "", None, "ab", "abc common"]
    left = spark.createDataFrame(list(enumerate(names)), "query_id int, text string")
    got = {(q, i): s for q, i, s in search.trigram_join(left, left.withColumnRenamed("query_id", "id")).collect()}

    def grams(t):
        return {f"  {w} "[k : k + 3] for w in (t or "").replace("-", " ").split() for k in range(len(w) + 1)}

    want = {}
    for a, x in enumerate(names):
        for b, y in enumerate(names):
            g, h = grams(x), grams(y)
            if g and h and len(g & h) / len(g | h) > 0.3:
                want[a, b] = round(len(g & h) / len(g | h), 6)
    assert got == want
    assert [r[0] for r in left.select(search.code_like(F.col("text"))).collect()][:4] == [True, True, True, False]
