"""Passes over the coded texts do not grow in number with the candidates."""

from kinepair.llm import phrases
from tests.llm.test_phrases import compare, noise


def test_many_candidates_take_no_more_passes(spark, monkeypatch):
    sent, honest = [], phrases.Shipped
    monkeypatch.setattr(phrases, "PIECE", 7)
    monkeypatch.setattr(phrases, "Shipped", lambda session, value: sent.append(type(value).__name__) or honest(session, value))
    assert len(compare(spark.createDataFrame(noise(1), "text string, lang string").repartition(3), least=3)) > 8
    # One bitmap of words, one of counts for each length, one of pairs.
    assert len(sent) == 4 and set(sent) == {"Bitmap"}
