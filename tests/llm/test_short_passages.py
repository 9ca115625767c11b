"""op7's further column: what strings of half the length leave, beside columns that hold for the whole length."""

import random

from geoshroud.llm import queries, suffix_dedup


def test_text_without_shorter_strings_and_digests_of_the_longer(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(k)) for k in (4, 6, 8, 12, 20, 40)]
    texts = [" ".join(r.choice(passages) if r.random() < 0.3 else word() for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [texts[3], texts[5], "x" * 90, None, ""]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    rows = lambda d: sorted(tuple(x) for x in d.collect())
    both = suffix_dedup.dedup_spans(spark, df, 40, with_text=True, text_n=20)
    assert rows(both.drop("text")) == rows(suffix_dedup.dedup_spans(spark, df, 40))
    text = lambda d: sorted((x["doc_id"], x["text"] or "") for x in d.collect())
    assert text(both) == text(suffix_dedup.without_repeats(spark, df, 20))
    assert text(both) != text(suffix_dedup.dedup_spans(spark, df, 40, with_text=True))


def test_query_takes_passages_of_over_fifty_words_out_of_the_text(spark, tmp_path):
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = words(55)
    spark.createDataFrame([(i, f"{words(30)} {passage} {words(30)}") for i in range(2)] + [(2, words(90))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {x["doc_id"]: x for x in queries.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(passage not in x["text"] and x["n_removed"] == 0 for x in out.values())
    assert len(out[2]["text"]) == out[2]["n_bytes"]
