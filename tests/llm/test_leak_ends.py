from ionloom.llm.leakage import leaks


def test_one_replaced_word_anywhere_in_a_short_passage(spark):
    """A passage of 14 words is found whichever word but the first and the last is replaced."""
    item = [f"word{chr(97 + i)}" for i in range(26)] + [f"other{chr(97 + i)}" for i in range(14)]
    rows = []
    for k in range(1, 13):
        quoted = item[10:24]
        quoted[k] = "changed"
        rows.append((k, " ".join(["before", "it", "stood", *quoted, "and", "then", "more"])))
    rows.append((99, " ".join(["before", *item[10:22], "and", "then", "more"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["words"], r["changed"]) for r in leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {k: (14, 1) for k in range(1, 13)}
