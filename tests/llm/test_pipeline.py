"""The pipeline's stages against brute-force versions of their decisions, on the smallest tables."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

from engrama.llm import quality
from test_llm_small import SCHEMA, brute_components, brute_em, brute_features, brute_hits, brute_print, brute_removed, pairs

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality rules"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    judged = quality.quality(docs).collect()
    good = brute_em([[r[f"vote_{x}"] for x in quality.RULES] for r in judged])
    texts = dict(pairs(docs))
    whole = {r["doc_id"] for r, p in zip(judged, good, strict=True) if p >= 0.5 and (f := brute_features(texts[r["doc_id"]]))[0] >= 20 and 100 * f[4] <= 30 * f[0]}
    assert {i for i, _ in pairs(kept)} == whole
    lines = stages["line dedup"](spark, kept, SF).cache()
    removed = {i: set(filter(None, r.split(","))) for i, _, _, r in brute_removed(pairs(kept), least=1)}
    assert sorted(pairs(lines)) == sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if str(k) not in removed[i])) for i, t in pairs(kept))
    one = stages["near-duplicates"](spark, lines, SF).cache()
    rows = sorted(pairs(lines))
    label = brute_components([brute_print(t) for _, t in rows])
    assert sorted(pairs(one)) == [r for k, r in enumerate(rows) if label[k] == k]
    clean = stages["decontamination"](spark, one, SF).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(pairs(clean)) == sorted(p for p in pairs(one) if not brute_hits(p[1], items)[4])
    last = stages["sentencepiece"](spark, clean, SF)
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    assert sorted((r["doc_id"], r["ids"]) for r in last.collect()) == sorted((i, library.encode(t or "")) for i, t in pairs(clean))
    assert last.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == clean.count()


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, equal ids, clashing columns, and no rows at all."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], None, None, None), (None, rows[6][1], None, None, None), (None, None, None, None, None), (900, None, "en", "s", None), (901, "", "en", "s", 0), (902, " \n\t", "en", "s", 3), (903, rows[7][1] * 40, "en", "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit(c) for c in ("doc", "removed", "_row", "_t", "_d", "hits", "digest", "fp", "kept", "n_words", "line", "key", "ids")}
    for name, table in (("odd", docs.withColumns(clash)), ("empty", docs.where("false"))):
        sf = f"{tmp_path}/{name}"
        table.write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        columns = at.columns
        for stage, function in corpus_pipeline.STAGES[:-1]:
            at = function(spark, at, sf)
            assert at.columns == columns, stage
            at.write.parquet(f"{sf}/{stage}")
            at = spark.read.parquet(f"{sf}/{stage}")
            if name == "odd":
                assert at.where("doc = 'doc' AND hits = 'hits' AND key = 'key'").count() == at.count() > 0
        got = corpus_pipeline.run(spark, sf)
        assert got.count() == at.count() and (name == "odd") == (got.count() > 0)


def test_what_a_worker_remembers_is_small():
    """Python workers stay through all stages, and with them the last stage's memory of stretches."""
    import tracemalloc

    from engrama.llm import pieces

    model = pieces.Pieces(corpus_pipeline.MODEL)
    tracemalloc.start()
    for i in range(400_000):
        model.remember(f"word{i}", b"%016d" % i)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 30 << 20
