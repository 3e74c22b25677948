import pytest

import corpus_pipeline
from tessera.llm import registry

CLASHES = "node spans row size score predicted held_out n_hit n_items item_ids contaminated number label row_key keys start end text_hash _gone id y copies".split()


def corpus():
    r = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    clean = [(i, " ".join(f"{w}{i}x{j}" for j in range(6) for w in r) + ".", "en", "s", 0) for i in range(1, 9)]
    shared = " ".join(f"shared{j}" for j in range(60))
    bench = " ".join(f"bench{j}" for j in range(12))
    docs = clean + [
        (20, clean[0][1] + " extra", "en", "s", 0), (21, " ".join(f"third{j}" for j in range(70)) + " " + shared, "fr", "s", 0), (22, " ".join(f"other{j}" for j in range(80)) + " " + shared, "en", "s", 0),
        (23, " ".join(f"more{j}" for j in range(90)) + " " + bench, "en", "s", 0), (24, "you idiot, you scum, moron " + " ".join(f"t{j}" for j in range(30)), "en", "s", 0), (25, None, "en", "s", None), (None, "no id here", None, None, None),
    ]
    return clean, docs, bench


def write(spark, folder, docs, bench, extra=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    d = spark.createDataFrame([(*x, *(f"{c} of {x[0]}" for c in extra)) for x in docs], schema)
    for name, df in {"documents": d, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, bench)], "item_id long, text string")}.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("extra", [(), CLASHES], ids=["plain", "clashing"])
def test_stages_keep_columns_and_clean_documents(spark, tmp_path, extra):
    clean, docs, bench = corpus()
    at = d = write(spark, tmp_path, docs, bench, extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.cut(stage(spark, at, str(tmp_path)), name)
        assert at.dtypes == d.dtypes
        seen[name] = {x["doc_id"]: x for x in at.collect()}
        assert all(x[c] == f"{c} of {i}" for i, x in seen[name].items() for c in extra)
    ids = {n: set(s) for n, s in seen.items()}
    whole = {x[0] for x in docs}
    assert ids["toxicity"] == whole - {24}
    assert ids["near_duplicates"] == whole - {24, 20}
    assert ids["repeated_passages"] == ids["near_duplicates"]
    assert "shared30" not in seen["repeated_passages"][22]["text"] and "other78" in seen["repeated_passages"][22]["text"]
    assert seen["repeated_passages"][22]["n_chars"] == len(seen["repeated_passages"][22]["text"]) and seen["repeated_passages"][3]["n_chars"] == 0
    assert all(seen["repeated_passages"][x[0]]["text"] == x[1] for x in clean)
    assert ids["decontamination"] == ids["repeated_passages"] - {23}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids["decontamination"]


def test_repeated_rows_and_long_texts(spark, tmp_path):
    clean, docs, bench = corpus()
    long = " ".join(f"long{j}" for j in range(60_000))
    docs = [*clean, clean[3], clean[3], (30, long, "en", "s", 0), (31, None, "en", "s", 0), (31, None, "en", "s", 0), (32, "", "en", "s", 0)]
    write(spark, tmp_path, docs, bench)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r["piece"])
    assert set(pieces) == {x[0] for x in docs}
    assert pieces[4] == [0] and sorted(pieces[31]) == [0, 0] and len(pieces[30]) > 100


def test_registered_queries_run_on_an_empty_corpus(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in [*registry.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
        assert query(spark, str(tmp_path)).collect() == [], name
