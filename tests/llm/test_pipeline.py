"""The pipeline on the smallest tables and on awkward rows."""

import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_and_run_agree(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stages(spark, docs, SF, tmp_path)
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns
    ids = [set(r[0] for r in out[n].select("doc_id").collect()) for n in out]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[0]) > 100
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()} == {tuple(r) for r in out["bpe"].select("doc_id", "n_tokens", "ids_sha256").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in out["mixing"].collect()}
    for r in out["bpe"].collect():
        assert list(r["ids"]) == library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_short_repeated_lines_go(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\nfirst"), (2, "second\n\nAll rights reserved."), (3, "All rights reserved.")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()} == {1: "All rights reserved.\nfirst", 2: "second\n"}


def test_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six seven", "en", "s", 33), (3, "one two three four five six seven", "en", "s", 33), (4, "one two three four five six seven", "fr", None, 33), (None, "no id but some words in it", "en", "s", 26), (5, "long " * 30_000, "en", "s", 150_000)]
    clashing = "quality_score double, n_dropped long, text_hash long, mix_sampled int, c0 string, id string, cls string"
    docs = spark.createDataFrame([(*r, 0.1, 3, 4, 0, None, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clashing)
    folder = tmp_path / "in"
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out = stages(spark, docs, str(folder), tmp_path / "out")
    assert out["quality"].count() == len(rows) and all(d.columns == docs.columns for d in list(out.values())[:-1])
    assert {r["doc_id"] for r in out["line_dedup"].collect()} == {1, 2, 3, 5, None}
    assert out["near_duplicates"].where("doc_id = 3").count() == 1
    empty = stages(spark, docs.where("doc_id < 0"), str(folder), tmp_path / "empty")
    assert all(d.count() == 0 for d in empty.values())


def test_rows_that_share_an_id_but_not_the_text(spark):
    """Only the row that leads its group stays; of equal rows with other columns a fixed one."""
    long = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, long, "a"), (2, long + " more", "b"), (2, "quite another text of some other words", "c"), (3, "a text that stands twice in the table", "d"), (3, "a text that stands twice in the table", "e"), (None, long, "f")], "doc_id long, text string, source string")
    kept = [sorted(r["source"] for r in corpus_pipeline.one_of_each_group(spark, d, SF).collect()) for d in (docs, docs.repartition(5), docs.orderBy("source", ascending=False))]
    assert kept[0] == kept[1] == kept[2] and set(kept[0]) - {"d", "e"} == {"a", "c", "f"} and len(kept[0]) == 4
