"""The pipeline against a plain version of its decisions."""

import corpus_pipeline
from tarmetric.llm import packing, quality, secrets
from tests.llm.test_operators import edited, plain_resemblance, prose

ITEM = "one two three four five six seven eight nine ten"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_pipeline_like_plain_decisions(spark, tmp_path):
    rows = [(k, prose(k, 120) if k % 4 else prose(k, 120).upper().replace(" ", "!! ")) for k in range(160)]
    rows += [(200 + k, rows[k][1]) for k in range(1, 30, 2)] + [(240 + k, edited(rows[k][1], 2, k)) for k in range(1, 20, 2)] + [(300, prose(900) + " " + ITEM), (301, None), (302, ""), (303, prose(901) + ' token = "24be64439e3e49cf46b2d7c90f"'), (5, rows[5][1])]
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k % 4 > 0), 0) for k in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    scored = quality.score_documents(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    good = {(r["doc_id"]) for r in scored if r["score"] >= 0.3}
    left = [(i, t) for i, t in rows if i in good]
    assert {i for i, _ in left} >= {k for k in range(160) if k % 4} and not {i for i, _ in left} & {k for k in range(160) if k % 4 == 0}
    kinds = plain_resemblance([t for _, t in left], [i for i, _ in left])
    kept = {i: t for (i, t), c in zip(left, kinds) if i == c}
    kept = {i: t for i, t in kept.items() if ITEM not in (t or "")}
    kept = {i: secrets.redact(t) for i, t in kept.items()}
    known = packing.piece_ids(packing.public_tokenizers.path(packing.TOKENIZER))
    want = {i: known.ids(t).tolist() for i, t in kept.items()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sums = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        sums[r["doc_id"]] = sums.get(r["doc_id"], []) + r["ids"]
    assert sums == want and 300 not in sums and (303 not in good or kept[303].endswith('[secret]"'))

    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
