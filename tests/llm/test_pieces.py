from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.llm.odd import odd_docs
from vinlake.llm import pieces
from vinlake.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


def plain_viterbi(p: pieces.Pieces, sp, text: str) -> float:
    """The best score of the whole text, without chunks or automaton."""
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        if marked[end - 1] not in score:
            best[end] = best[end - 1] + p.unknown
        for n in range(1, min(end, 24) + 1):
            s = score.get(marked[end - n : end])
            if s is not None:
                best[end] = max(best[end], best[end - n] + s)
    return best[-1]


def test_best_paths_and_round_trips(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    byte = set(p.bytes)
    assert p.ranks
    texts = [d.text or "" for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()] + ["日本語 🚗 テスト", "  two  spaces", "\ttab\n\n", "é ü ñ ß", "x" * 3000, "aaaaaaaab" * 50]
    assert all(p.encode(t).tolist() == sp.encode(t) for t in texts)  # merging, as the library does it
    p.clear()
    p.ranks = False  # from here on scores decide
    for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(30).collect():
        text = (d.text or "")[:400]
        ids = p.encode(text).tolist()
        assert p.decode(ids) == text
        if text and not byte & set(ids):
            assert abs(sum(map(sp.get_score, ids)) - plain_viterbi(p, sp, text)) < 1e-6
    for text in ("", " ", "  a  b ", "▁ already marked", "zero\0here ▁", "日本語 🚗\n\n\ttab", "x" * 5000):
        assert p.decode(p.encode(text).tolist()) == text


def test_query_and_odd_rows(spark):
    out = QUERIES["op6_sentencepiece"](spark, SF_DIR)
    assert out.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count() and out.filter(~F.col("round_trip")).isEmpty()
    df = odd_docs(spark)
    coded = pieces.encode(df)
    assert coded.count() == df.count() and coded.filter(~F.col("round_trip")).isEmpty()
    back = {(r.doc_id, r.text) for r in pieces.decode(coded).collect()}
    assert back == {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    assert pieces.encode(odd_docs(spark, 0)).count() == 0
