import os
import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.helpers import clashing, table, words
from tests.llm.test_mixing import brute as mix
from tests.llm.test_neardup import alike

VOCABULARY = {"en": "the old house stands on hill and nobody knows who built it there when winter came".split(), "de": "das alte haus steht auf dem hügel niemand weiß wer es dort gebaut hat als winter kam".split()}
SF = "/root/testdata/sf0.001"


def text(seed, lang, n=60):
    r = random.Random(f"{seed}{lang}")
    return " ".join(r.choice(VOCABULARY[lang]) + (str(r.randrange(100)) if k % 3 == 0 else "") for k in range(n))


def put(spark, folder, docs, items):
    pq.write_table(docs.toArrow(), f"{folder}/documents.parquet")
    pq.write_table(spark.createDataFrame(items, "item_id bigint, text string").toArrow(), f"{folder}/benchmark.parquet")


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    docs, gone = [], set()
    for k in range(120):
        docs.append([k, text(k, "de" if k % 4 == 0 else "en"), "de" if k % 4 == 0 else "en", "abc"[k % 3], 0])
    items = [(k, words(900 + k, 40, 3000)) for k in range(5)]
    for k in range(120, 130):  # near copies of documents before
        t = docs[k - 100][1].split()
        t[r.randrange(len(t))] = "changed"
        docs.append([k, " ".join(t), docs[k - 100][2], "a", 0])
        gone.add(k)
    for k in range(130, 135):  # passages of the benchmark
        docs.append([k, f"{text(k, 'en')} {items[k - 130][1]} {text(-k, 'en')}", "en", "b", 0])
        gone.add(k)
    docs += [[135, "Это русский текст о зиме и о доме на холме", "en", "c", 0], [136, "", "en", "a", 0], [137, None, "en", "a", 0]]
    gone |= {135, 136, 137}
    docs[7][1] += " write to john@doe.org"
    clean = {d: t for d, t, *_ in docs if d not in gone}
    assert not any(alike(a, b) >= 0.5 for i, a in clean.items() for j, b in clean.items() if i < j)
    clean[7] = clean[7].replace("john@doe.org", "[EMAIL]")
    put(spark, tmp_path, clashing(table(spark, docs)), items)
    got = corpus_pipeline.run(spark, str(tmp_path))
    want = mix([(d, clean[d], s) for d, _, _, s, _ in docs if d in clean])
    assert sorted(tuple(x[c] for c in ("doc_id", "source", "epoch", "start_token", "n_tokens", "take_tokens")) for x in got.collect()) == sorted(want)
    assert "[EMAIL]" in "".join(x["text"] for x in got.where("doc_id = 7").collect()) or not got.where("doc_id = 7").count()


def test_stages_hand_on_the_columns_of_documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes) == dict(docs.dtypes), name
        assert 0 < out.count() <= left


def test_empty_tables(spark, tmp_path):
    put(spark, tmp_path, table(spark, []), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
