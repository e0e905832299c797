from collections import Counter

from tellmark.llm import substrings


def test_texts_of_shared_and_null_ids_are_documents_each(spark):
    word = lambda n, m=30: " ".join(f"{n}{i}" for i in range(m))
    for one in (None, 3):
        data = [(one, word("a")), (one, word("a") + " " + word("b", 5)), (one, word("c", 25)), (one, word("d", 80) + " " + word("c", 25)), (9, word("d", 80))]
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        got = substrings.digests(df, 20).collect()
        assert sum(r["n_removed"] for r in got) == 30 + 25 + 80
        left = Counter(w for r in substrings.clean(df, 20).collect() for w in r["text"].split())
        assert left == Counter(set(" ".join(t for _, t in data).split()))
