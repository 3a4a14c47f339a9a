"""Queries of the positional lexical search and the stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.stem import STOP_WORDS, stem
from skein.functions.text import normalize_text
from skein.operators.branches import query_terms
from skein.operators.lexical import cover_search, postings
from skein.plans.more_queries import scratch
from skein.plans.registry import query

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
# The stems of a table v of words w without accents: regions by length of what stands before, then one step after another.
STEMS = r"""g AS (SELECT w, length(w) AS n,
  CASE WHEN length(w) < 2 THEN length(w) ELSE coalesce(nullif(length(regexp_extract(w, CASE WHEN regexp_matches(w, '^.[^aeiou]') THEN '^.[^aeiou][^aeiou]*[aeiou]' WHEN regexp_matches(w, '^[aeiou][aeiou]') THEN '^[aeiou][aeiou]+[^aeiou]' ELSE '^...' END)), 0), length(w)) END AS rv,
  coalesce(nullif(length(regexp_extract(w, '^[^aeiou]*[aeiou]+[^aeiou]')), 0), length(w)) AS r1,
  coalesce(nullif(length(regexp_extract(w, '^[^aeiou]*[aeiou]+[^aeiou][^aeiou]*[aeiou]+[^aeiou]')), 0), length(w)) AS r2 FROM v),
s0 AS (SELECT *, regexp_replace(w, '(selas|selos|sela|selo|las|les|los|nos|me|se|la|le|lo)$', '') AS base FROM g),
s1 AS (SELECT w, rv, r1, r2, CASE WHEN base <> w AND regexp_matches(base, '(iendo|ando|ar|er|ir|uyendo)$')
  AND length(base) - length(replace(regexp_extract(base, '(iendo|ando|ar|er|ir|uyendo)$'), 'uyendo', 'yendo')) >= rv THEN base ELSE w END AS x FROM s0),
s2 AS (SELECT *, regexp_extract(x, '(anzas?|icos?|icas?|ismos?|ables?|ibles?|istas?|osos?|osas?|amientos?|imientos?|adoras?|adores|ador|acion|aciones|antes?|ancias?|ucion|uciones|encias?|amente|mente|idad|idades|iva|ivo|ivas|ivos)$') AS e FROM s1),
s3 AS (SELECT *, length(x) - length(e) AS k, x[:length(x) - length(e)] AS b FROM s2),
s4 AS (SELECT *, CASE WHEN e = '' OR k < CASE WHEN e = 'amente' THEN r1 ELSE r2 END THEN NULL
  WHEN e IN ('ucion', 'uciones') THEN b || 'u' WHEN e IN ('encia', 'encias') THEN b || 'ente'
  WHEN regexp_matches(e, '^(adoras?|adores|ador|acion|aciones|antes?|ancias?)$') THEN CASE WHEN b LIKE '%ic' AND k - 2 >= r2 THEN b[:k - 2] ELSE b END
  WHEN e = 'mente' THEN CASE WHEN regexp_matches(b, '(ante|able|ible)$') AND k - 4 >= r2 THEN b[:k - 4] ELSE b END
  WHEN e IN ('idad', 'idades') THEN CASE WHEN b LIKE '%abil' THEN CASE WHEN k - 4 >= r2 THEN b[:k - 4] ELSE b END WHEN regexp_matches(b, '(ic|iv)$') AND k - 2 >= r2 THEN b[:k - 2] ELSE b END
  WHEN e IN ('iva', 'ivo', 'ivas', 'ivos') THEN CASE WHEN b LIKE '%at' AND k - 2 >= r2 THEN b[:k - 2] ELSE b END
  WHEN e = 'amente' THEN CASE WHEN b LIKE '%ativ' AND k - 4 >= r2 THEN b[:k - 4] WHEN regexp_matches(b, '(iv|os|ic|ad)$') AND k - 2 >= r2 THEN b[:k - 2] ELSE b END
  ELSE b END AS y FROM s3),
s5 AS (SELECT *, regexp_extract(x[rv + 1:], '(yeron|yendo|yamos|yais|yan|yen|yas|yes|ya|ye|yo)$') AS ye, regexp_extract(x[rv + 1:], '(aremos|eremos|iremos|asteis|isteis|ierais|ieseis|abais|arais|aseis|ieran|iesen|ieron|iendo|ieras|ieses|iera|iese|aste|iste|aban|aran|asen|aron|ando|abas|adas|idas|aras|ases|ados|idos|amos|imos|emos|aba|ada|ida|ara|ase|ado|ido|ad|ed|id|an|ar|er|ir|as|en|es)$') AS ve FROM s4),
s6 AS (SELECT *, CASE WHEN y IS NOT NULL THEN y WHEN ye <> '' AND x[:length(x) - length(ye)] LIKE '%u' THEN x[:length(x) - length(ye)]
  WHEN ve IN ('en', 'es', 'emos') AND x[:length(x) - length(ve)] LIKE '%gu' THEN x[:length(x) - length(ve) - 1] ELSE x[:length(x) - length(ve)] END AS z FROM s5),
stems AS (SELECT w, CASE WHEN z LIKE '%os' THEN CASE WHEN length(z) - 2 >= rv THEN z[:length(z) - 2] ELSE z END
  WHEN z LIKE '%a' OR z LIKE '%o' THEN CASE WHEN length(z) - 1 >= rv THEN z[:length(z) - 1] ELSE z END
  WHEN z LIKE '%e' AND length(z) - 1 >= rv THEN CASE WHEN z LIKE '%gue' AND length(z) - 2 >= rv THEN z[:length(z) - 2] ELSE z[:length(z) - 1] END ELSE z END AS stem FROM s6)"""
_TOKENS = "regexp_extract_all(strip_accents(lower(trim({}))), '[a-z0-9]+')"


@query("lex_1_stems", f"""WITH t AS (SELECT unnest({_TOKENS.format("coalesce(text, '')")}) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t WHERE w NOT IN ({_STOP}) GROUP BY w), v AS (SELECT w FROM c), {STEMS}
SELECT stem AS token, count(*) AS words, CAST(sum(n) AS BIGINT) AS places FROM c JOIN stems USING (w) GROUP BY stem""")
def _(t):
    """The stems of all words of the documents: how many words share each, and in how many places."""
    words = t("documents").select(F.explode(F.regexp_extract_all(normalize_text(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    counts = words.where(~F.col("w").isin(*sorted(STOP_WORDS))).groupBy("w").agg(F.count("*").alias("n"))
    stemmed = F.pandas_udf(lambda s: s.map(stem), "string")
    return counts.groupBy(stemmed("w").alias("token")).agg(F.count("*").alias("words"), F.sum("n").alias("places"))


@query("lex_4_cover_rank", f"""WITH r AS (SELECT doc_id AS id, doc_id % 7 = 0 AS bare, string_split(coalesce(text, ''), ' ') AS w, coalesce(text, '') AS text FROM documents),
parts AS (SELECT id, 'A' AS tier, array_to_string(w[1:3], ' ') AS t FROM r WHERE NOT bare UNION ALL SELECT id, 'D', array_to_string(w[4:], ' ') FROM r WHERE NOT bare UNION ALL SELECT id, 'F', text FROM r WHERE bare),
tok AS (SELECT id, tier, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT id, tier, {_TOKENS.format("t")} AS w FROM parts)),
kept AS (SELECT * FROM tok WHERE w NOT IN ({_STOP})),
qw AS (SELECT item_id AS query_id, regexp_extract_all(strip_accents(lower(text)), '[a-z]{{4,}}') AS w FROM benchmark),
terms AS (SELECT query_id, 0 AS alt, 'word' AS kind, w[1] AS w, 1 AS off FROM qw UNION ALL SELECT query_id, 0, 'word', w[2], 1 FROM qw
  UNION ALL SELECT query_id, 1, 'phrase', w[3], 1 FROM qw UNION ALL SELECT query_id, 1, 'phrase', w[4], 2 FROM qw UNION ALL SELECT query_id, 1, 'excluded', w[7], 1 FROM qw),
v AS (SELECT DISTINCT w FROM (SELECT w FROM kept UNION ALL SELECT w FROM terms WHERE w IS NOT NULL)), {STEMS},
sh AS (SELECT id, max(pos) AS shift FROM kept WHERE tier = 'A' GROUP BY id),
hits AS (SELECT k.id, st.stem AS token, k.pos + CASE WHEN tier = 'D' THEN coalesce(shift, 0) ELSE 0 END AS pos, CASE WHEN tier = 'A' THEN 1.0 ELSE 10.0 END AS inv FROM kept k JOIN stems st ON st.w = k.w LEFT JOIN sh ON sh.id = k.id),
lex AS (SELECT DISTINCT query_id, alt, kind, off, stem AS token FROM terms JOIN stems USING (w) WHERE terms.w NOT IN ({_STOP})),
need AS (SELECT DISTINCT query_id, alt, token FROM lex WHERE kind <> 'excluded'),
size AS (SELECT query_id, alt, count(*) AS n FROM need GROUP BY 1, 2),
alts AS (SELECT m.query_id, m.alt, h.id FROM need m JOIN (SELECT DISTINCT id, token FROM hits) h ON h.token = m.token JOIN size z ON z.query_id = m.query_id AND z.alt = m.alt GROUP BY 1, 2, 3, z.n HAVING count(*) = z.n),
lines AS (SELECT a.query_id, a.alt, a.id, l.kind, h.pos - l.off AS s, count(*) AS n FROM alts a JOIN lex l ON l.query_id = a.query_id AND l.alt = a.alt AND l.kind <> 'word' JOIN hits h ON h.id = a.id AND h.token = l.token GROUP BY ALL),
asked AS (SELECT query_id, alt, kind, count(*) AS n FROM lex WHERE kind <> 'word' GROUP BY ALL),
there AS (SELECT DISTINCT query_id, alt, id, kind FROM lines JOIN asked USING (query_id, alt, kind, n)),
pairs AS (SELECT DISTINCT a.query_id, a.id FROM alts a WHERE NOT EXISTS (FROM there t WHERE t.query_id = a.query_id AND t.alt = a.alt AND t.id = a.id AND t.kind = 'excluded')
  AND (EXISTS (FROM there t WHERE t.query_id = a.query_id AND t.alt = a.alt AND t.id = a.id AND t.kind = 'phrase') OR NOT EXISTS (FROM asked k WHERE k.query_id = a.query_id AND k.alt = a.alt AND k.kind = 'phrase'))),
ev AS (SELECT DISTINCT p.query_id, p.id, h.pos, h.token, h.inv FROM pairs p JOIN need m ON m.query_id = p.query_id JOIN hits h ON h.id = p.id AND h.token = m.token),
lastp AS (SELECT e.query_id, e.id, e.pos, m.alt, m.token, max(f.pos) AS p FROM ev e JOIN need m ON m.query_id = e.query_id JOIN ev f ON f.query_id = e.query_id AND f.id = e.id AND f.token = m.token AND f.pos <= e.pos GROUP BY ALL),
starts AS (SELECT query_id, id, pos, max(s) AS s FROM (SELECT l.query_id, l.id, l.pos, l.alt, min(p) AS s FROM lastp l JOIN size z ON z.query_id = l.query_id AND z.alt = l.alt GROUP BY l.query_id, l.id, l.pos, l.alt, z.n HAVING count(*) = z.n) GROUP BY 1, 2, 3),
covers AS (SELECT query_id, id, s, min(pos) AS e FROM starts GROUP BY 1, 2, 3),
sums AS (SELECT c.query_id, c.id, c.s, c.e, count(*) AS n, sum(v.inv) AS inv FROM covers c JOIN ev v ON v.query_id = c.query_id AND v.id = c.id AND v.pos BETWEEN c.s AND c.e GROUP BY ALL)
SELECT query_id, id, round(sum(n / inv / (1 + (e - s) - (n - 1))), 6) AS rank FROM sums GROUP BY 1, 2""")
def _(t):
    """Documents for words of the benchmark's items: two words, or a phrase without another
    word. Tier A: the first three words, D: the others; every seventh has its fallback text only."""
    bare, words = F.col("doc_id") % 7 == 0, F.split(F.coalesce("text", F.lit("")), " ")
    docs = t("documents").select(
        "doc_id", F.when(bare, "").otherwise(F.array_join(F.slice(words, 1, 3), " ")).alias("head"),
        F.when(bare, "").otherwise(F.array_join(F.slice(words, F.lit(4), F.size(words)), " ")).alias("rest"), F.when(bare, F.col("text")).alias("whole"),
    )
    w = F.regexp_extract_all(normalize_text(F.col("text")), F.lit("[a-z]{4,}"), F.lit(0))
    get = lambda k: F.get(w, k)
    text = F.concat(get(0), F.lit(" "), get(1), F.lit(' or "'), get(2), F.lit(" "), get(3), F.lit('" -'), get(6))
    terms = query_terms(t("benchmark").select(F.col("item_id").alias("query_id"), text.alias("text")))
    path = scratch(docs.sparkSession)
    postings(docs, "doc_id", {"head": "A", "rest": "D"}, "whole").write.parquet(path)
    return cover_search(docs.sparkSession.read.parquet(path), terms)
