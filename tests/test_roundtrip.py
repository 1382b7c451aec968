"""Placeholders that digits follow: the text comes back whole."""

from hushlake.operators import detect, pseudonymize


def test_digits_behind_a_value(spark):
    rows = [
        (1, "call +1 (269) 555-3296 4524132264652876 and so on"),  # the pattern ends three digits before the number does
        (2, "call +1 (269) 555-3296 4524132264652876 or +1 (269) 555-3296 45241322646521"),
        (3, "+1 (269) 555-3296 4524132264652_a@b.org"),
        (4, "call +1 (269) 555-3296 or a@b.org, c@d.org"),
        (5, None),
    ]
    docs = detect.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    out, entities = pseudonymize.pseudonymize(docs)
    back = pseudonymize.restore(out, entities, "doc_id", "pseudonymized")
    assert {r["doc_id"]: r["restored"] for r in back.collect()} == dict(rows)
    hidden = {r["doc_id"]: r["pseudonymized"] for r in out.collect()}
    assert hidden[1] == "call +1 PHONE_1 and so on"
    assert hidden[4] == "call +1 PHONE_1 or EMAIL_1, EMAIL_2"
