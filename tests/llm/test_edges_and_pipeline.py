"""Defined results at the edges of every operator, and the pipeline as a whole."""

import random
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from decoylog.llm.queries import PIECES, vocabulary  # noqa: E402
from decoylog import llm  # noqa: E402
from decoylog.llm import (  # noqa: E402
    alignment,
    bpe,
    components,
    decontaminate,
    fill_middle,
    language_id,
    license_scan,
    line_dedup,
    quality_model,
    quality_rules,
    repeats,
    simhash,
    token_counts,
)

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def items(spark):
    rows = [(1, "a row without an id, twice and then some more words here"), (None, "one"), (2, None)]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(items):
    path = vocabulary()
    fold = F.col("doc_id") % 4 == 2
    return {
        "op1": lambda d: language_id.identify(d, F.coalesce(fold, F.lit(False)), F.lit(False)),
        "op2": quality_model.classify,
        "op3": simhash.near_duplicates,
        "op4": lambda d: decontaminate.contamination(d, items),
        "op5": repeats.without_repeats,
        "op6": lambda d: bpe.encode_documents(d, path),
        "op7": lambda d: token_counts.count_tokens(d, path),
        "op8": line_dedup.line_report,
        "op9": license_scan.scan,
        "op10": quality_rules.judge,
        "op12": lambda d: alignment.align_documents(d, path, public_tokenizers.path(PIECES)),
        "op13": fill_middle.fill_in_middle,
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op12", "op13"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(edges, items, name):
    found = operators(items)[name](edges).collect()
    ids = Counter(r.doc_id for r in edges.collect())
    assert Counter(r.doc_id for r in found) == ids
    equal = [tuple(r) for r in found if r.doc_id == 5]
    assert equal[0] == equal[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(nothing, items, name):
    assert operators(items)[name](nothing).collect() == []


def test_edge_values(edges, items):
    by = {name: {} for name in NAMES}
    for name, run in operators(items).items():
        for r in run(edges).collect():
            by[name].setdefault(r.doc_id, r)
    assert {by["op3"][i].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert [by["op3"][i].component_id for i in (1, 2, 3)] == [1, 1, 1]
    assert by["op3"][4].component_id == by["op3"][5].component_id == 4
    assert (by["op4"][4].n_hit, by["op4"][4].n_items, by["op4"][4].item_ids) == (1, 0, [])
    assert by["op4"][None].n_hit == 0 and by["op4"][1].n_words == 0
    assert by["op5"][6].n_removed > 90_000 and by["op5"][1].n_bytes == 0
    assert by["op6"][1].n_tokens == 0 == by["op7"][2].n_tokens
    assert by["op8"][1].n_lines == 0 and by["op8"][2].n_lines == 1 and by["op8"][5].n_removed == 1
    assert (by["op12"][1].n_a, by["op12"][2].groups_sha256, by["op12"][1].groups) == (0, "", [])
    assert by["op12"][None].n_links > 0 and by["op12"][6].n_a > 20_000
    assert (by["op13"][1].n, by["op13"][2].form, by["op13"][1].prefix_chars) == (0, "plain", None)
    assert by["op13"][6].n == 3_001 + 40_000
    assert by["op10"][6].n_words == 20_001 and by["op10"][6].base_failed


def test_component_chains(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    links = list(zip(order, order[1:])) + [(1000, n) for n in range(1001, 1300)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components.components(frame).collect()}
    assert found == {n: 0 for n in range(400)} | {n: 1000 for n in range(1000, 1300)}


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture
def corpus(spark, tmp_path, docs_of, words):
    source = random.Random(3)
    passage = words(30)
    rows = [(i, words(90) + "\nshared line of boilerplate text\n" + words(40)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200 + i, words(60) + " " + passage + " " + words(20)) for i in range(3)]
    rows += [(300, "x$ " * 90), (301, "too short"), (302, None), (303, rows[7][1] + " " + words(1))]
    source.shuffle(rows)
    docs = docs_of(rows)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), dict(rows)


def test_pipeline(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, folder).columns == docs.columns, name
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not {300, 301, 302, 200, 201, 202} & set(found)
    clean = {i for i in rows if i < 40}
    # Copies lose all their lines; what is left of them is one and the same text.
    assert clean <= set(found) and len(set(found) - clean) <= 2
    library = bpe.Coder(bpe.read_vocabulary(vocabulary()))
    first = min(clean)
    text = "".join(library.decode(iter([found[first].ids])))
    assert text == rows[first]
    assert "shared line" not in "".join(library.decode(iter([found[39].ids])))


@pytest.mark.parametrize("number", range(4))
def test_stages_at_the_edges(spark, corpus, edges, nothing, number):
    folder, _ = corpus
    name, function = corpus_pipeline.STAGES[number]
    assert function(spark, nothing, folder).collect() == []
    kept = function(spark, edges, folder)
    assert kept.columns == edges.columns
    rows, before = Counter(map(str, kept.collect())), Counter(map(str, edges.collect()))
    if name == "SimHash near-dedup":
        assert max(rows.values()) == 1
    if name != "line dedup":
        assert rows <= before
    else:
        assert sum(rows.values()) == sum(before.values())


FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = connection.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    found = llm.queries()[name](spark, str(FOLDER))
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    assert rows == sorted(map(repr, result.fetchall()))


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in llm.queries())
    assert numbers == list(range(1, 14))
    used = {f.__name__ for _, f in corpus_pipeline.STAGES}
    assert len(used) == 5
