"""The whole pipeline, stage by stage, against what each stage promises."""

import random
import re

import corpus_pipeline
from netquarry.session import stage

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {"labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}


def corpus():
    rng = random.Random(40)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(3000)]
    rows, labels, roles = [], [], {}
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(5)]
    for i in range(400):
        own, role = rng.choices(vocabulary, k=rng.randint(30, 90)), "clean"
        if i % 8 == 0:
            role = "toxic"
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["grubbel", "wrenk", "zottox"]))
        elif i % 8 == 1:
            role = "leak"
            own[5:5] = rng.choice(items)[1].split()
        elif i % 8 == 2:
            role = "copy"
            own = list(rows[-1][1].split()) if roles[i - 1] == "clean" else own
        roles[i] = role
        rows.append((i, " ".join(own), rng.choice(["en", "de"]), rng.choice(["hot", "hot", "b", "c"]), 1))
        labels.append((i, 1, int(role == "toxic")))
    first = next(i for i in roles if roles[i] == "clean")
    copies = [(1000 + i, rows[first][1] + " tail" * i, "en", "hot", 1) for i in range(4)]
    return rows + copies + [(None, None, None, None, None)], labels, items, roles, first


def test_stages(spark, frame, tmp_path):
    rows, labels, items, roles, first = corpus()
    for name, data in (("labels", labels), ("benchmark", items)):
        frame(data, TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    frame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = stage(apply(spark, docs, str(tmp_path)), "test")
        assert out.columns == docs.columns
        assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
        docs, left[name] = out, {r["doc_id"] for r in out.collect()}
    clean = {i for i in roles if roles[i] == "clean"}
    assert clean <= left["toxicity"] and not left["toxicity"] & {i for i in roles if roles[i] == "toxic"}
    assert clean <= left["near-dedup"] and not left["near-dedup"] & {1000, 1001, 1002, 1003}
    assert clean <= left["decontamination"] and not left["decontamination"] & {i for i in roles if roles[i] == "leak"}
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    kept = sum(words[i] for i in left["mixing"]) / sum(words[i] for i in left["decontamination"])
    assert corpus_pipeline.MIX.budget <= kept <= corpus_pipeline.MIX.budget + 0.1
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == left["mixing"] and len(last) == len(left["mixing"])


def test_pipeline_of_empty_tables(spark, frame, tmp_path):
    frame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    for name, ddl in TABLES.items():
        frame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]
