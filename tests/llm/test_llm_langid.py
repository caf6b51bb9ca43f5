from pyspark.sql import functions as F

from cohortspark.llm import langid
from cohortspark.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = langid.held_out(F.col("doc_id"))
    net = langid.fit(docs.where(~held))
    rows = langid.predict(docs.where(held), net).join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    again = langid.fit(docs.where(~held))
    assert (again.filters == net.filters).all() and (again.out == net.out).all()


def test_texts_without_letters(docs, odd_texts):
    net = langid.train(["the words of this", "les mots de cela"] * 8, ["en", "fr"] * 8)
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs(*odd_texts), net).collect()}
    for i, text in enumerate(odd_texts):
        assert (found[i] == "und") == (text is None or not any(c.isalpha() for c in text))
    assert langid.known(docs(*odd_texts), net, least=0.0).count() == sum(x != "und" for x in found.values())
    assert {r.lang_pred for r in langid.predict(docs("text"), None).collect()} == {"und"}


def test_every_window_counts():
    net = langid.train(["the words of this", "les mots de cela"] * 8, ["en", "fr"] * 8)
    assert len(langid.cut_windows(b"x" * 1000)) == 4 and len(langid.cut_windows(b"")) == 1
    english = "the words of this " * 200
    _, (a, b) = langid.predictions(net, [english, english + "les mots de cela " * 50])
    assert a != b


def test_only_letters_make_a_language(docs):
    found = langid.predict(docs("\u00bd \u00b2", "\u2167 123", "1 2 3 !", None, "a word"), langid.fit(docs("one two three", "four five")))
    assert [r.lang_pred == "und" for r in sorted(found.collect(), key=lambda r: r.doc_id)] == [True, True, True, True, False]
