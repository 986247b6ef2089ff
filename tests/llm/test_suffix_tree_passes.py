"""Hashes of a bucket's words, and answers that several passes read."""

from gauge_engine.llm.suffix_tree import _word_hashes, suffix_tree_scores


def test_words_of_a_bucket_are_hashed_together():
    long = "x" * 200
    texts = ["One  two\tONE\n", None, "", " \x0b\x0c\r ", f"{long}a {long}b {long}a", "é É two ab ba", "a\x00 a"]
    hashes, sizes = _word_hashes(texts)
    assert sizes.tolist() == [3, 0, 0, 0, 3, 5, 2]
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(set(hashes.tolist())) == len(set(words))
    assert len(set(zip(hashes.tolist(), words))) == len(set(words))
    assert [len(x) for x in _word_hashes([None, ""])] == [0, 2]


def test_answers_of_an_exchange_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"a b c d {i}") for i in range(40)], "doc_id long, text string")
    plan = suffix_tree_scores(docs)._jdf.queryExecution().executedPlan().toString()
    # Answers to several passes are not united anew for each of them.
    assert "FlatMapCoGroupsInPandas" in plan and "Union" not in plan
