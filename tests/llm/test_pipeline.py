import corpus_pipeline as C

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, kept = docs, [docs.count()]
    for _, stage in C.STAGES[:-1]:
        rows = C.staged(stage(spark, rows, SF), "test")
        assert rows.dtypes == docs.dtypes
        kept.append(rows.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4] > 0.7 * kept[0]
    assert rows.where(r"text rlike '[a-z]@mail[0-9]+\\.example'").count() == 0
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len({r.doc_id for r in rows.select("doc_id").collect()} & toxic) < 0.4 * len(toxic)
    packed = C.STAGES[-1][1](spark, rows, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in rows.select("doc_id").collect()}


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, None), (3, "a b c d e f g"), (4, "a b c d e f g"), (5, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1.0, "q", 9.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, id string, toxicity double")
    for table in (docs, docs.limit(0), docs.drop("n_chars")):
        out = table
        for _, stage in C.STAGES[:-1]:
            out = C.staged(stage(spark, out, SF), "test")
            assert out.columns == table.columns
        assert out.count() == (6 if table.count() else 0)
        assert {r.toxicity for r in out.collect()} <= {9.5}
        assert C.STAGES[-1][1](spark, out, SF).count() >= out.count()


def test_run_keeps_only_its_result(spark):
    """run() gives the pieces of what its stages keep, and deletes the tables on the way."""
    out = C.run(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in C.STAGES:
        rows = C.staged(stage(spark, rows, "/root/testdata/sf0.001"), "test")
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert key(out) == key(rows)
