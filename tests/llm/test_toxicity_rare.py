import random

from termloom.llm import toxicity


def test_words_of_few_documents_are_caught_in_a_large_corpus(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(4, 7))) for _ in range(2_000)]
    rows, bad = [], set(range(0, 20_000, 1_250))  # 16 documents of 20,000
    for i in range(20_000):
        w = rng.choices(vocab, k=12)
        if i in bad:
            w[rng.randrange(12)] = "zzslur"
        rows.append((i, " ".join(w)))
    labels = [(i, int(i in bad)) for i in range(0, 20_000, 25)]
    got = toxicity.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert {r["doc_id"] for r in got if r["n_hits"] and r["toxic"]} == bad
