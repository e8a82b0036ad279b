import random

import corpus_pipeline
from strandline.llm import pieces

from .test_text_operators import words


def test_stages_on_planted_rows(spark, tmp_path):
    rnd = random.Random(6)
    vocab = [f"wort{i}" for i in range(300)] + ["the", "of", "and"] * 30
    sentence = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    question = sentence(40)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        docs.append((i, sentence(40) + (" idiot scum moron idiot" if toxic else "") + "\nShare this page", "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    base = sentence(120)
    docs += [(1000, base, "en", "p"), (1001, base, "en", "p"), (1002, base + " end", "en", "p"), (1003, sentence(20) + " " + question + " " + sentence(20), "en", "p"), (1004, "clean words only here", "en", "p"), (1005, None, "en", "p"), (1006, "", "en", "p"), (1007, "scum scum idiot moron trash scum", "en", "p")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, question)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i in range(0, 900, 5)} | {1007}
    assert len(toxic & set(got)) <= 3
    assert {1000, 1004, 1005, 1006} <= set(got) and not {1001, 1002, 1003} & set(got)
    clean = {i for i in range(900) if i % 5}
    assert len(clean - set(got)) <= 5
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    for i in sorted(clean & set(got))[:50]:
        assert got[i].ids == library.encode(docs[i][1].removesuffix("\nShare this page"))
    assert got[1000].ids == library.encode(base) and got[1005].n_tokens == 0
    assert len(words(question)) == 40


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = [(i, f"text {i} one two three four five six", "en", "s", 5, "x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 30
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
