from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.llm.odd import odd_docs
from vinlake.llm import langid
from vinlake.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op9_language"](spark, SF_DIR.replace("sf0.001", "sf0.01")).collect()}
    docs = spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()
    known = [d for d in docs if d.lang and got[d.doc_id].held_out and got[d.doc_id].lang_pred != "und"]
    assert len(got) == len(docs) and sum(got[d.doc_id].lang_pred == d.lang for d in known) >= 0.97 * len(known)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for r, t in ((got[d.doc_id], d.text) for d in docs))


def plain_parse(sample, text):
    """Phrases by looking for ever longer parts in the sample."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        count, at = count + 1, at + max(1, n - 1)
    return count


def test_counts_are_those_of_one_parse(monkeypatch):
    """Whole texts over many blocks, characters that no sample has, and texts that the sample holds from end to end, so that a phrase runs over whole blocks."""
    docs = duckdb.sql(f"SELECT text, lang FROM '{SF_DIR.replace('sf0.001', 'sf0.01')}/documents.parquet' WHERE text <> '' ORDER BY doc_id").fetchall()
    texts = [langid.normal(t) for t, _ in docs if any(map(str.isalpha, t))]
    samples = {"a": " ".join(texts[:4]), "b": " ".join(texts[4:7])}
    for block in (langid.BLOCK, 16):
        monkeypatch.setattr(langid, "BLOCK", block)
        given = [*texts[7:110], *texts[:4], samples["b"], "xy" + texts[2], "日本語 text", *(t[3:] for t in texts[100:200])]
        found = langid.Model(samples).counter()(given)[0]
        assert len(given) >= 200 and found.tolist() == [[plain_parse(samples[x], t) for x in "ab"] for t in given]


def test_large_alphabets(spark):
    """Two languages of 1,500 letters each, which share none, and a third of few letters."""
    rng = random.Random(4)
    alphabets = {"x": [chr(0x4E00 + i) for i in range(1500)], "y": [chr(0xAC00 + i) for i in range(1500)], "z": list("abcdefgh")}
    rows = [(i, "".join(rng.choices(alphabets[x], k=300)), x) for i, x in enumerate(list("xyz") * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == x for i, _, x in rows)


def test_odd_rows(spark):
    df = odd_docs(spark)
    out = langid.identify(df, langid.fit(df), carry=("score", "lang"))
    assert out.count() == df.count() and {r.lang_pred for r in out.select("lang_pred").collect()} <= {"en", "fr", "und"}
    none = langid.identify(df, langid.fit(odd_docs(spark, 0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.identify(odd_docs(spark, 0), langid.fit(df)).count() == 0


def test_more_languages_than_one_model_holds(spark, monkeypatch):
    """103 labelled languages, each of letters of its own: all are learnt, dealt out to models, and predicted; predictions are those of one model."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(103 * 6)]
    rows = [(i, "".join(rng.choice(letters[i % 103 * 6 : i % 103 * 6 + 6]) for _ in range(120)), f"l{i % 103:03}") for i in range(103 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert isinstance(model, langid.Models) and [len(p.languages) for p in model.parts()] == [100, 3]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model, carry=("text",)).collect()}
    assert got == {i: lang for i, _, lang in rows}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")))
    for reject in (False, True):
        monkeypatch.setattr(langid, "LANGUAGES", 100)
        want = sorted(map(tuple, langid.identify(docs, langid.fit(docs), reject=reject).collect()), key=repr)
        monkeypatch.setattr(langid, "LANGUAGES", 2)
        assert isinstance(langid.fit(docs), langid.Models)
        assert sorted(map(tuple, langid.identify(docs, langid.fit(docs), reject=reject).collect()), key=repr) == want
