import random

from conftest_llm import ODD, words

import corpus_pipeline as pipeline

BENCH = [(1, " ".join(words(30, 777))), (2, None)]


def corpus():
    """Documents with an id each, by what should become of them."""
    prose = {k: words(220, k) for k in range(100, 140)}
    clean = {k: " ".join(w) for k, w in prose.items()}
    near = {200 + k: " ".join(["edit"] + prose[100 + k][1:]) for k in range(5)}
    copies = {210 + k: clean[110 + k] for k in range(5)}
    shared = {220 + k: " ".join(words(150, 300 + k) + prose[120 + k][30:110] + words(40, 400 + k)) for k in range(5)}
    leaks = {230 + k: " ".join(words(100, 500 + k) + words(30, 777)[3:20] + words(100, 600 + k)) for k in range(5)}
    junk = {240: "spam " * 300, 241: "few words only"}
    return clean, near, copies, shared, leaks, junk


def test_stages(spark, table, tmp_path):
    clean, near, copies, shared, leaks, junk = corpus()
    rows = [*ODD, *clean.items(), *near.items(), *copies.items(), *shared.items(), *leaks.items(), *junk.items(), (139, clean[139])]
    random.Random(1).shuffle(rows)
    docs = table(rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    after_quality, after_dedup, after_cut, after_bench = ids
    assert set(after_quality) >= set(clean) | set(near) | set(copies) | set(shared) | set(leaks)
    assert not set(after_quality) & set(junk) and None not in after_quality
    assert sorted(after_dedup) == sorted({*clean, *shared, *leaks})
    texts = {r.doc_id: r for r in docs.collect()}
    assert sorted(after_cut) == sorted(after_dedup)
    for k in shared:
        assert texts[k].text.split() == words(150, 80 + k) + words(40, 180 + k)
        assert texts[k].n_chars == len(texts[k].text)
    assert all(texts[k].text == clean[k] for k in clean)
    assert sorted(after_bench) == sorted({*clean, *shared})
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == sorted(after_bench)
    assert all(r.n_tokens > 100 for r in last)


def test_stages_on_odd_rows(spark, table, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], ODD):
        for _, stage in pipeline.STAGES:
            out = stage(spark, table(rows).select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path))
            assert len(out.collect()) <= len(rows)
