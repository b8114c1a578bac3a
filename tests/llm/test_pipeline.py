from __future__ import annotations

import random

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.odd import TEXTS, odd_docs
from vinlake.llm import pieces


def test_stages_and_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, seen, SF_DIR)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.count() <= seen.count() and out.count() == out.select("doc_id").distinct().count()
    final = corpus_pipeline.run(spark, SF_DIR)
    assert final.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and final.filter("not round_trip").isEmpty() and final.count() > 0
    first = pieces.decode(final.limit(5)).collect()
    assert all(r.text for r in first)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids and rows, ties, clashing columns: what each stage keeps, by plain rules."""
    given = odd_docs(spark)
    rows = [tuple(r) for r in given.select(*corpus_pipeline.COLUMNS).collect()]
    by_language = [tuple(r) for r in corpus_pipeline.language_id(spark, given, SF_DIR).collect()]
    assert sorted([r[:2] for r in by_language], key=repr) == sorted([r[:2] for r in rows if any(map(str.isalpha, r[1] or ""))], key=repr)
    seen = spark.createDataFrame(by_language, given.select(*corpus_pipeline.COLUMNS).schema)
    spread = [tuple(r) for r in corpus_pipeline.line_spread(spark, seen, SF_DIR).collect()]
    assert sorted(r[:2] for r in spread if r[0] is not None) == sorted(r[:2] for r in by_language if r[0] is not None)  # no line is on ten sites
    words = lambda t: " ".join(t.encode().lower().decode().split())
    near = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(spread, seen.schema), SF_DIR).collect()]
    # Of these texts only those of equal words are alike.
    want = {w: min((r[0] is None, r[0] or 0) for r in spread if words(r[1]) == w) for w in {words(r[1]) for r in spread}}
    assert len(near) == len(want) and {words(r[1]): (r[0] is None, r[0] or 0) for r in near} == want
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, spark.createDataFrame(near, seen.schema), SF_DIR).collect()]
    assert {r[0] for r in mixed} <= {r[0] for r in near} and abs(sum(len(r[1].split()) for r in mixed) - sum(len(r[1].split()) for r in near)) <= 10
    ids = corpus_pipeline.tokens(spark, spark.createDataFrame(mixed, seen.schema), SF_DIR).collect()
    assert len(ids) == len(mixed) and all(r.round_trip for r in ids)
    empty = odd_docs(spark, 0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name


def test_near_dedup_keeps_null_and_repeated_ids(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    def rows(docs):
        return sorted((tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()), key=repr)

    given = [
        (None, text("a"), "en", "s1"), (None, text("b"), "en", "s1"), (None, text("b") + " more", "en", "s2"),  # no id at all: two groups
        (1, text("c"), "en", "s1"), (None, text("c"), "en", "s1"),  # a copy without an id
        (5, text("c") + " more", "en", "s1"), (5, text("d"), "en", "s1"), (5, text("e"), "en", "s1"),  # one id: a near copy of 1 and two clean texts
        (7, text("f"), "fr", "s2"), (7, text("f"), "en", "s3"), (7, text("f"), "en", "s2"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(docs)
    kept = {(r[0], r[1]) for r in got}
    assert len(got) == len(kept) == 6 and all(len(r[1]) == r[4] for r in got)
    assert kept - {(None, text("b")), (None, text("b") + " more")} == {(None, text("a")), (1, text("c")), (5, text("d")), (5, text("e")), (7, text("f"))}
    assert [r[2:4] for r in got if r[0] == 7] == [("en", "s2")]
    assert rows(docs.orderBy("text", ascending=False)) == rows(docs.repartition(5)) == got

    odd = {(r[0], r[1]) for r in rows(odd_docs(spark))}
    assert {(None, "an id that is null"), (3, "another text"), (3, TEXTS[3])} <= odd and not {6, 12} & {i for i, _ in odd}


def test_language_decides(spark):
    """Wrong tags are overruled, text of no learnt language goes, and all else stays as it was."""
    words = {
        "en": "the of and to in that was his with as had this from they not which have were their there been would when who will more said what about up out them".split(),
        "de": "der die und in den von zu das mit sich des auf nicht eine als auch es an werden aus er hat dass sie nach wird bei einer um noch wie einem über".split(),
        "fr": "le de un être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme leur si même".split(),
    }
    rng = random.Random(11)

    def text(lang, n=60):
        at = rng.randrange(40)  # words follow each other in some order, as they do in sentences
        return " ".join(words[lang][(at := at + rng.choice((1, 1, 1, 2))) % len(words[lang])] for _ in range(n))

    clean = [(i, text(x), x, "s", 0) for i, x in enumerate(x for x in words for _ in range(60))]
    tagged = [(1000 + i, text(x), y, "s", 0) for i, (x, y) in enumerate([("de", "en"), ("fr", "de"), ("en", None)])]
    noise = "".join(rng.choice("bcdfghjklmnpqrstvwxyz ") for _ in range(400))
    strange = [(2000, noise, "en", "s", 0), (2001, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4, "en", "s", 0), (2002, noise, None, "s", 0)]
    short = [(3000, "the", "en", "s", 0), (3001, "+49 30 1234567 und", "de", "s", 0)]
    docs = spark.createDataFrame(clean + tagged + strange + short, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, SF_DIR).collect()}
    assert [got.pop(1000 + i, None) for i in range(3)] == ["de", "fr", "en"]
    assert not {2000, 2001, 2002} & set(got)
    assert got == {r[0]: r[2] for r in clean + short}
