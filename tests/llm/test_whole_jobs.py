"""What must not be left out of a job of the training-data operators."""

from docspark.llm import private, quotes


def test_terms_of_a_value_in_one_text_are_found_wherever_they_stand(spark):
    rare = "Quillfeather grows here. " + "plain words again " * 20 + "write to a@b.org now. " + "plain words again " * 20 + "so says quillfeather."
    texts = [rare] + [f"plain words again write to now says here grows {i}" for i in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["spans"], r["n_terms"]) for r in private.private_spans(df).collect()}
    m, z = rare.index("a@b"), rare.index("quill")
    assert rows.pop(0) == (f"term_removed:0:12,email:{m}:{m + 7},term_removed:{z}:{z + 12}", 2)
    assert set(rows.values()) == {("", 0)}


def test_nested_passages_link_and_stand_in_for_a_lost_parent(spark):
    rows = [(1, 0, "a", "first words"), (1, 1, "b", "> first words\nsecond words"), (1, 2, "c", ">> first words\n> second words, edited\nthird"), (1, 3, "d", ">> first words\n> second words\nfourth")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["thread"], r["depth"], r["n_quotes"], r["n_nested"]) for r in quotes.linked_messages(df).collect()}
    assert got == {0: (None, 0, 0, 0, 0), 1: (0, 0, 1, 1, 0), 2: (0, 0, 1, 0, 1), 3: (1, 0, 2, 1, 1)}


def test_mail_keeps_every_row(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 2, "a", "z"), (1, 2, "a", "z"), (None, 0, "a", "lost"), (1, None, "a", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["role"], r["text"]) for r in quotes.as_mail(df).collect())
    assert got == sorted([("b", "x"), ("a", "y"), ("a", "> y\nz"), ("a", "> y\nz"), ("a", "lost"), ("a", "")])
