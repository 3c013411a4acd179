import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    line = "this very line is printed below every article of all the sites"
    rows = []
    for i in range(120):
        words = [f"w{(i * 37 + k * k * 11 + k * 5) % 4001}" for k in range(80 + i % 30)]
        rows.append((i, " ".join(words) + "\n" + line, "en", f"src{i % 4}", 0))
    rows += [(200 + i, rows[i][1], "en", "src9", 0) for i in range(10)]
    rows += [(300, "too short", "en", "src1", 9), (301, None, None, None, None), (302, "", "en", "src1", 0), (None, rows[5][1] + " more", "en", "src2", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    folder = write(spark, tmp_path / "in", docs, labels)
    now, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        sizes.append(now.count())
    assert sizes[0] == 131 and sizes[1] == 131
    assert sizes[2] <= 122
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in packed) > 0 and max(r.offset + r.length for r in packed) <= 2048


def test_empty(spark, tmp_path):
    folder = write(spark, tmp_path / "none", spark.createDataFrame([], COLUMNS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0
