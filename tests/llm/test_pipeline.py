import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import invented
from tests.llm.test_packing import ids_of


@pytest.fixture(scope="module")
def tables(spark, documents, tmp_path_factory):
    rng = random.Random(11)
    item = invented(4242, 30, 10**6)
    passage = "every page of this host carries this very same line of text"
    good = [(i, invented(i, rng.randrange(60, 200), 5000), "h") for i in range(150)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in invented(i, 80, 5000).split()), "h") for i in range(60)]
    base = invented(999, 200, 10**6)
    copies = [(300 + i, base if i % 2 else " ".join(base.split()[: 199 - i] + [f"edit{i}"] + base.split()[200 - i :]), "h") for i in range(10)]
    leaks = [(400, f"{invented(1, 60)} {item} {invented(2, 60)}", "h")]
    lined = [(500 + i, f"{invented(7000 + i, 80, 5000)}\n{passage}", "p") for i in range(40)]
    short = [(600, "too short"), (601, None), (602, "a b c d e " * 30)]
    rows = good + bad + copies + leaks + lined + short
    folder = str(tmp_path_factory.mktemp("tables"))
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}


def test_stages_take_effect(spark, tables, tmp_path):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    good, lined = set(range(150)), set(range(500, 540))
    assert ids["quality_rules"] == set(texts) - {600, 601, 602}
    assert ids["quality_classifier"] >= good | lined | {400} and not ids["quality_classifier"] & set(range(200, 260))
    assert ids["near_dedup"] == ids["quality_classifier"] - set(range(301, 310))
    assert ids["decontamination"] == ids["near_dedup"] - {400}
    kept = {r.doc_id: r for r in docs.collect()}
    assert all(kept[i].text == texts[i].split("\n")[0] and kept[i].n_chars == len(kept[i].text) for i in lined)
    assert all(kept[i].text == texts[i] for i in good)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(kept)
    for p in pieces:
        own = ids_of(kept[p.doc_id].text)
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())


def test_run_gives_the_same(spark, tables):
    folder, _ = tables
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").count()
    assert 150 <= got <= 205


EXTRA = ("key", "row", "part", "n", "text_key", "kept", "removed", "id", "band", "item_id", "place", "label")


def test_empty_tables_and_clashing_columns(spark, documents, tables, tmp_path):
    folder, texts = tables
    rows = [(i, t, "h") for i, t in texts.items() if i < 40] + [(700, None, None), (701, "", "h"), (None, invented(1, 70, 5000), "h"), (3, texts[3], "h"), (702, "a b " * 50_000, None)]
    none = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{none}/benchmark.parquet")
    documents([]).write.parquet(f"{none}/documents.parquet")
    for name, docs, where in (("rows", documents(rows, EXTRA), folder), ("empty", documents([], EXTRA), folder), ("unlabelled", documents(rows, EXTRA), none), ("nothing", documents([], EXTRA), none)):
        columns, ids = docs.columns, [r[0] for r in rows]
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            fn(spark, docs, where).write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            assert docs.columns == columns
        kept = [r.doc_id for r in docs.collect()]
        if name in ("empty", "nothing"):
            assert kept == [] and corpus_pipeline.STAGES[-1][1](spark, docs, where).collect() == []
        else:
            assert set(kept) <= set(ids) and set(range(40)) <= set(kept) | {i for i in range(40) if name == "unlabelled"}
            assert kept.count(3) <= 1 and not {700, 701, 702} & set(kept)
            assert {p.doc_id for p in corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()} == set(kept)
