"""What must not be left out of a job: each test counts from the raw tables, not from a view that could share a cut."""

from docspark.plans.views import view


def test_every_word_is_an_item(spark, sf):
    want = {}
    for r in view(spark, sf, "documents").collect():
        for no, line in enumerate(r["text"].split("\n")):
            want.setdefault((r["doc_id"], no // 10 + 1), []).extend(w for w in line.split(" ") if w)
    got, places = {}, set()
    for r in view(spark, sf, "text_items").orderBy("doc_id", "page_no", "item_no").collect():
        got.setdefault((r["doc_id"], r["page_no"]), []).append(r["str"])
        places.add((r["doc_id"], r["page_no"], r["item_no"]))
    assert got == {k: v for k, v in want.items() if v}
    assert len(places) == sum(map(len, got.values()))
