"""Languages whose labelled documents are all longer than the training excerpt are learned."""

import random

from tidelog.llm import language_id


def test_long_documents_are_learned(spark):
    words = {"en": "the of and with over under house tree water".split(), "de": "der und mit haus baum wasser über nicht auch".split()}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60 if lang == "en" else 1500)), lang) for i in range(60) for lang in [["en", "de", "de"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language_id.SAMPLE_CHARS for _, t, lang in rows if lang == "de")
    for given, order in ((docs, ["de", "en"]), (docs.where("lang = 'de'"), ["de"])):
        dictionaries = language_id.fit(given)
        assert [lang for lang, _ in dictionaries] == order  # by all labelled rows, most first
        assert all(x["lang_pred"] == x["rest"]["lang"] for x in language_id.identify(given, dictionaries).collect())
