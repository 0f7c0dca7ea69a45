"""Repeat groups over whole texts, rows without an id, and shards that are split again."""

from collections import defaultdict

import numpy as np
import pytest

from decoylog import llm
from decoylog.llm import repeats, simhash
from decoylog.llm.license_texts import KNOWN

LEAST = repeats.LEAST


def occurrences(texts):
    found = defaultdict(set)
    for doc_id, text in texts:
        data = text.encode()
        for start in range(len(data) - LEAST + 1):
            found[data[start : start + LEAST]].add((doc_id, start))
    return {s: places for s, places in found.items() if len(places) > 1}


@pytest.mark.parametrize("case", ["copies", "passage", "mixed"])
def test_every_repeated_string_has_a_group_of_all_occurrences(docs_of, words, case):
    passage, other = words(120), words(60)
    texts = {
        "copies": [(i, passage) for i in range(3)],
        "passage": [(i, words(9) + passage + words(11)) for i in range(5)],
        "mixed": [
            (1, passage), (2, passage), (3, words(5) + passage), (4, passage[:300] + other),
            (5, other + passage[200:]), (6, other), (7, other + " " + other), (8, words(50)),
        ],
    }[case]
    rows = repeats.maximal_repeats(docs_of(texts)).collect()
    text = {i: t.encode() for i, t in texts}
    groups = defaultdict(set)
    for r in rows:
        groups[(r.group, r.length)].add((r.doc_id, r.start))
    marked = [r.group for r in rows if r.earliest]
    assert sorted(marked) == sorted({r.group for r in rows}) and len(groups) == len(marked)
    by_string = defaultdict(list)
    for (_, length), places in groups.items():
        strings = {text[d][s : s + length] for d, s in places}
        assert len(strings) == 1 and len(places) > 1
        (string,) = strings
        for delta in range(length - LEAST + 1):
            by_string[string[delta : delta + LEAST]].append({(d, s + delta) for d, s in places})
    for string, places in occurrences(texts).items():
        assert places in by_string[string]


def test_a_row_without_an_id_is_held_out_of_nothing(spark, docs_of, words, tmp_path):
    source = [(i, words(30), lang, "s") for i, lang in enumerate(["en", "de"] * 20)]
    docs_of([*source, (None, words(9), "en", "s"), (None, None, None, None)]).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = llm.queries()["op1_language_id"](spark, str(tmp_path)).collect()
    assert all(isinstance(r.held_out, bool) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]


def test_licence_sql_knows_what_the_scan_knows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [*KNOWN.values(), *(t.upper().replace("\n", "\r\n * ") for t in KNOWN.values())]
    texts += ["Copyright (c) 2024 A. Name\n\n" + KNOWN["MIT"], "no licence", "", None, " \n", "The licence's centre & more"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = connection.execute(llm.oracle_sql()["op9_license_scan"])
    columns = [c[0] for c in result.description]
    found = llm.queries()["op9_license_scan"](spark, str(tmp_path)).select(*columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, result.fetchall()))
    assert found.where("license_id IS NOT NULL").count() > len(KNOWN)


# --- op3: shards that one sample cannot shape are dealt again ------------------


def test_large_shards_are_split_again(spark, monkeypatch):
    source = np.random.default_rng(17)
    loose = source.integers(0, 1 << 63, 2500, dtype=np.uint64)
    near = loose[:600] ^ (np.uint64(1) << source.integers(0, 62, 600, dtype=np.uint64))
    dense = np.uint64(12345) ^ (np.uint64(1) << source.integers(0, 62, 40, dtype=np.uint64))
    values = np.unique(np.concatenate((loose, near, dense)))
    distinct = spark.createDataFrame([(int(v),) for v in values], "fingerprint bigint")
    monkeypatch.setattr(simhash, "SHARD_SIZE", 64)
    monkeypatch.setattr(simhash, "SAMPLE", 512)
    dealt = []
    again = simhash._dealt_again
    monkeypatch.setattr(
        simhash, "_dealt_again", lambda d, reach: dealt.append(again(d, reach)) or dealt[-1]
    )
    found = simhash.links(distinct, 2).collect()
    homes = dealt[0].where("home")
    assert homes.count() == len(values)
    sizes = [r["count"] for r in homes.groupBy("shard").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 128
    least = {int(v): int(v) for v in values}

    def root(v, up):
        while up[v] != v:
            v = up[v]
        return v

    plain = dict(least)
    for v in values:
        for w in values[np.bitwise_count(values ^ v) <= 2]:
            a, b = root(int(v), plain), root(int(w), plain)
            plain[max(a, b)] = min(a, b)
    for r in found:
        assert (r.a ^ r.b).bit_count() <= 2 or root(r.a, plain) == root(r.b, plain)
        a, b = root(r.a, least), root(r.b, least)
        least[max(a, b)] = min(a, b)
    assert all(root(int(v), least) == root(int(v), plain) for v in values)
