"""Pruned hits, flags, confidence and second runs on odd rows."""

from skein.operators import relevance, verdicts

HIT = "query_id int, id int, relevance double, primary_coverage double, identifier boolean, exact int, lexical boolean, term_coverage double, fields int"
LIMIT = "query_id int, min_relevance double, min_coverage double, limit int"


def hits(spark, *rows):
    return spark.createDataFrame(rows, HIT)


def test_prune(spark):
    rows = hits(
        spark, (1, 1, 0.9, 1.0, False, 0, True, 1.0, 0), (1, 2, 0.1, 0.0, True, 0, True, 1.0, 0), (1, 3, 0.9, 0.4, False, 9, True, 1.0, 0), (1, 4, 0.5, 0.5, None, None, True, 1.0, 0),
        (1, 5, None, 1.0, False, 0, True, 1.0, 0), (1, 6, 0.5, 0.5, False, 1, True, 1.0, 0), (2, 7, 0.2, 1.0, False, 0, True, 1.0, 0), (9, 8, 1.0, 1.0, True, 0, True, 1.0, 0),
    )
    top, counts = verdicts.prune(rows, spark.createDataFrame([(1, 0.5, 0.5, 3), (2, 0.5, 0.0, 3), (3, 0.0, 0.0, 1)], LIMIT))
    assert sorted((r.query_id, r.place, r.id) for r in top.collect()) == [(1, 1, 2), (1, 2, 6), (1, 3, 1)]
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 4, 2), (2, 0, 1), (3, 0, 0)]


def confidence(spark, query, *rows, preferences=0):
    q = spark.createDataFrame([(1, *query, preferences)], "query_id int, requested int, applied int, limit int, free_text boolean, hybrid boolean, preferences int")
    found = hits(spark, *rows)
    top, _ = verdicts.prune(found, spark.createDataFrame([(1, 0.0, 0.0, query[2])], LIMIT))
    return verdicts.query_confidence(q, top, found, verdicts.preference_misses(q, found)).first().confidence


def test_confidence(spark):
    hit = lambda n, score, lex, cover, fields=0: (1, n, score, 1.0, False, 0, lex, cover, fields)
    assert confidence(spark, (0, 0, 2, True, True), hit(1, 1.0, True, 1.0), hit(2, 0.5, False, 0.0)) == 0.875
    assert confidence(spark, (4, 1, 2, True, True)) == 0.0375  # no hits: the filters' share alone
    assert confidence(spark, (0, 0, 1, True, True), hit(1, 1.0, False, 0.3)) == 0.42  # vectors only, hardly a word of the query
    assert confidence(spark, (0, 0, 1, True, False), hit(1, 1.0, False, 0.3)) == 0.625  # not hybrid
    assert confidence(spark, (0, 0, 1, True, True), hit(1, 1.0, False, 0.5)) == 0.675  # enough words
    assert confidence(spark, (0, 0, 1, True, True), hit(1, 1.0, False, 0.3), hit(2, 0.1, True, 0.0)) == 0.625  # a candidate past the limit was found by words
    assert confidence(spark, (0, 0, 1, True, True), hit(1, 1.0, True, 1.0), preferences=2) == 0.5
    assert confidence(spark, (0, 0, 1, True, True), hit(1, 1.0, True, 1.0, 1), preferences=2) == 1.0
    assert confidence(spark, (0, 0, 0, True, True), hit(1, 0.0, None, None)) == 0.15


def test_second_run(spark):
    queries = spark.createDataFrame([(1, "a b", "a"), (2, "a", "a"), (3, "zz", "a"), (4, "zz", "a"), (5, "zz", "a")], "query_id int, text string, original string")
    kinds = "query_id int, field string, op string, value string, implicit boolean, protected boolean, boost double"
    filters = spark.createDataFrame([(1, "f", "eq", "no", True, False, 0.4), (2, "f", "eq", "yes", True, False, None), (3, "f", "eq", "no", False, False, None), (5, "f", "eq", "no", True, False, None), (5, "g", "eq", "no", True, True, None)], kinds)

    def search(q, f):
        return q.where("text = 'a'").join(f.where("value = 'no'"), "query_id", "left_anti").select("query_id", q.text.alias("by"))

    found, moved = relevance.search_relaxed(queries, filters, search)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", True), (2, "a", False)]  # 5 keeps its protected filter
    assert sorted((r.query_id, r.field, r.boost) for r in moved.collect()) == [(1, "f", 0.4), (5, "f", 0.25)]
