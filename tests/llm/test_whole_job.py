"""Corpus operators: cases in which a part of the job was once left out."""

import hashlib
import random
import time
import re
from collections import Counter

import corpus_pipeline
import pytest

from skein.llm import jaccard_join
from skein.llm.license_scan import TEMPLATES, scan_licenses
from skein.llm.quality_classifier import FEATURES, statistics
from skein.llm.secret_scan import find_secrets, lexed_spans, redact
from skein.llm.substring_dedup import cuts, remove_repeats, repeated_documents


def test_top_word_counts_all_words():
    words = [f"w{k}" for k in range(80)]
    words[1::10] = ["often"] * 8  # at no place that is a multiple of 10
    assert statistics(" ".join(words).encode())[FEATURES.index("top_word")] == 8 / 80
    moved = statistics(" ".join(["new", *words]).encode())
    assert moved[FEATURES.index("top_word")] == 8 / 81


@pytest.mark.parametrize(
    "text, want",
    [
        ('password: str = "s3cretvalue"', ["s3cretvalue"]),
        ('name: str = "harmless12"\npassword: str = "s3cretvalue"', ["s3cretvalue"]),
        ("let token: string = 's3cretvalue';", ["s3cretvalue"]),
        ('def f(user: str, pwd: Optional[str] = "s3cretvalue", n: dict[str, int] = None):', ["s3cretvalue"]),
        ('pwd: str | None = "s3cretvalue"', ["s3cretvalue"]),
        ('var password string = "s3cretvalue"', ["s3cretvalue"]),
        ('var (\n\tname string = "harmless12"\n\tpassword string = "s3cretvalue"\n)', ["s3cretvalue"]),
        ('var pwd []byte = "s3cretvalue"', ["s3cretvalue"]),
        ('const string pwd = "s3cretvalue"', ["s3cretvalue"]),
        ('password = b"s3cretvalue"', ["s3cretvalue"]),
        ("pwd = rb's3cretvalue'", ["s3cretvalue"]),
        ('pwd = f"s3cretvalue"', ["s3cretvalue"]),
        ('pwd = """s3cret\nvalue"""', ["s3cret\nvalue"]),
        ('passphrase = "correct horse battery staple"', ["correct horse battery staple"]),
        ('pwd = KEY\nKEY = "s3cretvalue"', ["s3cretvalue"]),
        ('a = b\nb = a\npwd = a', []),
        ('K = "s3cretvalue"\npwd = K\nK = "harmless12"', ["s3cretvalue"]),
        ('if secret: name = "harmless12"', []),
        ('if secret: pwd = "s3cretvalue"', ["s3cretvalue"]),
        ('f(token: str, name="harmless12")', []),
        ("run: KEY=s3cretvalue\nPWD=$KEY", ["s3cretvalue"]),
        ("db_password = $DB_PASSWORD_ENV", []),
        ("db_password = ${DB_PASSWORD_ENV}", []),
        ('db_password = os.environ["DB_PASS1"]', []),
        ("db_password = get_database_password1()", []),
        ("db_password = config.database.password", []),
        ("db_password = default_password", []),
        ("{ password: dbPassword, user: name }", []),
        ("password: correcthorsebattery\nuser: someone", ["correcthorsebattery"]),
        ("PASSWORD=correcthorsebattery\nUSER=someone", ["correcthorsebattery"]),
        ('pwd = "s3cret" + "value9"', ['s3cret" + "value9']),
        ('pwd = ("a")\nname = "harmless12"', []),
        ("db:\n  private_key: |\n    MIIEpAIBAAKCAQEA\n    7f3kq9\n  user: someone", ["MIIEpAIBAAKCAQEA\n    7f3kq9"]),
        ("<config><password>s3cretvalue</password><user>harmless12</user></config>", ["s3cretvalue"]),
        ('<add key="name" password="s3cretvalue"/>', ["s3cretvalue"]),
        ("my_" + "very_" * 40 + "long_password = 's3cretvalue'", ["s3cretvalue"]),
        ('{"db": {"password": "s3cretvalue"}}', ["s3cretvalue"]),
        ("headers['auth_token'] = 's3cretvalue'", ["s3cretvalue"]),
        ("x" * 300_000 + "= 1\n" + "a=b" * 50_000, []),
    ],
)
def test_assignment_forms(text, want):
    assert [text[a:b] for a, b in lexed_spans(text, 0.5)] == want


def test_base_spans_are_those_of_the_patterns(spark, sf):
    kinds = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abcdef", "\n", "é", "x.y/z=", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    seen = Counter()
    for k, text in enumerate(texts):
        spans = [(m.start(), n, m.end()) for n, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= least]
        counts = Counter(kinds[n][0] for _, n, _ in spans)
        seen += counts
        base = ",".join(f"{kinds[n][0]}:{s}:{e}" for s, n, e in sorted(spans))
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(got[k].spans.split(","))
    assert min(seen.values()) > 20


def test_bare_values_end_where_they_should():
    for text, found in [
        ("https://x.org/a?token=abcdef123456&user=bob&page=2&sort=asc", ["abcdef123456"]),
        ("password=hunter2abc&next=/home", ["hunter2abc"]),
        ("password=YWJjZGVmZw==\n", ["YWJjZGVmZw=="]),
        ('token = f"{a}{b}"', []),
        ('token = f"abc123def{b}"', ["abc123def{b}"]),
        ("token = `${a}`", []),
        ('if token == "abc123def":', ["abc123def"]),
        ('if (secret !== "zx81spectrum") {}', ["zx81spectrum"]),
        ("Authorization: Bearer abc123def456ghi", ["abc123def456ghi"]),
        ('"Authorization": "Bearer abc123def456ghi"', ["abc123def456ghi"]),
        ("Authorization: Basic authentication is needed", []),
    ]:
        assert [text[s:e] for s, e in lexed_spans(text, 0.5)] == found, text
    url = "https://x.org/a?token=abcdef123456&user=bob"
    assert redact(url, 0.5, "[secret]").endswith("[secret]&user=bob")


@pytest.mark.parametrize("bit", ["k{}=v{}x&", "x=", "a: ", "token=abc=", '"a{}": "b{}", ', "token: Bearer a1 ", "<a>b</a>"])
def test_work_grows_as_the_line(bit):
    """Four times the text in one line takes less than eight times the time."""
    def seconds(n):
        text = "".join(bit.replace("{}", str(i)) for i in range(n))
        began = time.process_time()
        lexed_spans(text, 0.5)
        return time.process_time() - began

    few, many = min(seconds(10_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert many < max(8 * few, 0.5)


def test_typed_secret_is_masked():
    text = 'name: str = "harmless12"\npassword: str = "s3cretvalue"'
    assert redact(text, 0.5, "#") == 'name: str = "harmless12"\npassword: str = "#"'


def test_passage_whose_chunks_have_other_holders(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))
    passage = prose(60)
    ends = cuts(passage.encode())
    rows = [(100, f"{prose(40)} {passage} {prose(40)}"), (200, f"{prose(50)} {passage} {prose(30)}")]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):  # each chunk, with what its cuts depend on, in a document of its own
        rows.append((1 + k, f"{prose(20)} {passage[max(0, a - 40) : b]} {prose(20)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repeated_documents(docs).collect()}
    assert {100, 200} <= set(got) and got[200].n_bytes > 0.6 * len(passage) and got[200].removable_bytes == got[200].n_bytes
    assert got[100].n_runs == got[200].n_runs == 1
    old, new = dict(rows), {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    assert len(old[200]) - len(new[200]) == got[200].removable_bytes and len(old[100]) - len(new[100]) == got[100].removable_bytes


def test_only_repeated_chunks_are_removed(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))
    one, two, own = prose(80), prose(80), "OWN " * 12
    docs = spark.createDataFrame([(1, f"{one} {prose(11)} {two}"), (2, f"{one} {own} {two}"), (2, prose(90))], "doc_id long, text string")
    new = sorted((r.text for r in remove_repeats(docs).where("doc_id = 2").collect()), key=lambda x: "OWN" in x)
    assert own.strip() in new[1] and len(new[1]) < 400 and len(new[0].split()) == 90


def test_license_notices_over_lines_and_in_long_lines(spark):
    wrapped = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal"""
    bsd = "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted"
    spread = " ".join(w + " filler" * 40 for w in TEMPLATES[1][0].split())  # one line, every word of the template
    inside = "filler " * 3000 + TEMPLATES[1][0] + " filler" * 3000
    rows = [(1, wrapped), (2, bsd), (3, spread), (4, inside), (5, f"{wrapped}\n\n{bsd}\n\n{wrapped}")]
    got = {r.doc_id: (r.labels, r.n_blocks) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1), 2: ("bsd", 1), 3: ("", 0), 4: ("mit", 1), 5: ("bsd,mit", 3)}
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_blocks_are_found(spark):
    """Labels and score against every window of every text."""
    rng = random.Random(7)
    templates = [(" ".join(rng.sample("abcdefghijklmnop", n)), f"t{k}") for k, n in enumerate((4, 6, 6, 9, 11))] + [("a a b c b", "t0")]
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=[9] * 5 + [3] * 11 + [12] * 10, k=rng.randint(0, 60))) for _ in range(500)]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, threshold=0.7, reach=1.5).collect()
    labelled = 0
    for r in rows:
        words, labels, score = texts[r.doc_id].split(), set(), 0.0
        for text, label in templates:
            whole, width = set(text.split()), int(1.5 * len(text.split()))
            most = max((len(whole & set(words[k : k + width])) for k in range(len(words) + 1)), default=0)
            if most >= 0.7 * len(whole) - 1e-9:
                labels.add(label)
                score = max(score, most / len(whole))
        labelled += len(labels)
        assert (r.labels, r.score) == (",".join(sorted(labels)), score)
    assert labelled > 50


def test_stage_finds_near_copies_by_five_words(spark, sf):
    words = [f"w{k}" for k in range(185)]  # 161 of 201 shingles of five words are shared: 0.801; 166 of 198 of four: 0.838
    other = [f"x{k}" if k in (30, 60, 90, 120) else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()] == [1]


def test_texts_of_common_sentences(spark, monkeypatch):
    """Every shingle is frequent, lists are long and dealt into blocks; links against brute force."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 16)
    rng = random.Random(3)
    sentences = [" ".join("".join(rng.choices("abcdefg", k=4)) for _ in range(8)) for _ in range(30)]
    texts = [" ".join(rng.sample(sentences, 10)) for _ in range(150)]
    for k in range(0, 150, 5):  # chains of near copies
        words = texts[k].split()
        words[rng.randrange(80)] = "changed"
        texts.append(" ".join(words))
        words[rng.randrange(80)] = "again"
        texts.append(" ".join(words))
    sets = [set(zip(w, w[1:], w[2:], w[3:])) for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(k for k in range(len(texts)) if group[k] == g) for g in set(group)}
    assert len(least) < len(texts) - 40
    got = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: least[g] for k, g in enumerate(group)}


def test_bitmaps_never_exclude_a_link():
    rng = random.Random(8)
    for _ in range(300):
        x = jaccard_join.np.array(rng.sample(range(1, 1 << 40), rng.randint(1, 900)), jaccard_join.np.uint64)
        y = jaccard_join.np.union1d(x[: rng.randint(0, len(x))], jaccard_join.np.array([rng.randrange(1 << 40) for _ in range(rng.randint(1, 300))], jaccard_join.np.uint64))
        both = len(set(x.tolist()) & set(y.tolist()))
        assert jaccard_join.most_shared(len(x), len(y), jaccard_join.parity(x), jaccard_join.parity(y)) >= both


def test_stages_stand_odd_rows(spark, sf):
    """Nulls, empty, repeated and long rows, clashing columns and an empty table go through all stages but the last unchanged in shape."""
    schema = "doc_id long, text string, n_words string, score double, key long, n_chars long"
    rows = [(None, None, "a", None, 1, None), (1, None, None, 1.0, None, 0), (2, "", "b", 1.0, 2, 0), (3, "word " * 50_000, "c", 1.0, 3, 5), (3, "word " * 50_000, "c", 1.0, 3, 5), (None, "a b", None, None, None, 3)]
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert got.count() <= len(rows) and stage(spark, empty, sf).count() == 0, name
    assert corpus_pipeline.near_duplicates(spark, docs, sf).count() == 5
    last = corpus_pipeline.pieces(spark, docs, sf)
    assert last.count() == len(rows) and last.where("not lossless").count() == 0 and corpus_pipeline.pieces(spark, empty, sf).count() == 0
