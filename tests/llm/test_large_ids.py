"""Ids that a double cannot hold, beside null ids in the same batch."""

from collections import Counter

import pytest

from ballast.llm import jaccard, language, licenses, packing, toxicity, warc

BIG = 2**53 + 1
IDS = [BIG, None, BIG + 2, 2**62 + 1, None, -(2**60) - 1, 5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"text of number {k} word. Released under the MIT License.", "en") for k, i in enumerate(IDS)], "doc_id long, text string, lang string").coalesce(1)


def ids(found):
    return Counter(r.doc_id for r in found.select("doc_id").collect())


def test_ids_come_back_as_they_are(spark, docs):
    want = Counter(IDS)
    net = toxicity.fit(docs, spark.createDataFrame([(BIG, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int"))
    assert ids(toxicity.score_documents(docs, net)) == want
    assert ids(language.identify(docs, language.learn(docs))) == want
    assert ids(packing.pack(docs)) == want
    assert ids(jaccard.near_duplicates(docs)) == want
    assert ids(licenses.license_spans(docs)) == want


def test_pages(spark):
    rows = [(BIG, "http://a.com/", "same"), (BIG + 2, "http://a.com/", "same"), (None, "http://b.com/", "other"), (2**62 + 1, "http://c.com/", "same"), (3, None, None), (2**63 - 1, "u", "x"), (-(2**62), "u", "x")]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    got = {r.page_id: (r.record_type, r.refers_to) for r in found.collect()}
    assert got == {BIG: ("response", None), BIG + 2: ("revisit", BIG), None: ("response", None), 2**62 + 1: ("revisit", BIG), 3: ("response", None), 2**63 - 1: ("revisit", -(2**62)), -(2**62): ("response", None)}
