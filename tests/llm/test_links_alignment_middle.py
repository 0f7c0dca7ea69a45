"""Vector links, token alignment and fill-in-middle against plain definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from decoylog.llm import alignment, embedding_links, fill_middle
from decoylog.llm.queries import PIECES, vocabulary

# --- vectors -------------------------------------------------------------------


def brute_links(rows, threshold=0.9):
    """n_links and component of each row, by place."""

    def usable(v):
        return v is not None and len(v) > 0 and all(
            x is not None and math.isfinite(x) for x in v
        ) and any(x != 0 for x in v)

    unit = {}
    for at, (_, v) in enumerate(rows):
        if usable(v):
            a = np.array(v, np.float64)
            a /= np.abs(a).max()
            unit[at] = a / np.linalg.norm(a)
    near = defaultdict(set)
    by_length = defaultdict(list)
    for at, a in unit.items():
        by_length[len(a)].append(at)
    for places in by_length.values():
        m = np.array([unit[p] for p in places])
        for i, j in zip(*np.nonzero(m @ m.T >= threshold)):
            if i != j:
                near[places[i]].add(places[j])
    component = {}
    for at in range(len(rows)):
        if at in component:
            continue
        seen, stack = {at}, [at]
        while stack:
            for other in near[stack.pop()] - seen:
                seen.add(other)
                stack.append(other)
        ids = [rows[p][0] for p in seen if rows[p][0] is not None]
        component |= dict.fromkeys(seen, min(ids) if ids else None)
    return [(rows[p][0], len(near[p]), component[p]) for p in range(len(rows))]


def clusters(seed, count, size, dim, cosine):
    """Rows around common directions; two of a cluster have about the cosine given."""
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(count):
        centre = draw.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        noise = draw.standard_normal((size, dim)) / math.sqrt(dim)
        rows += (math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * noise).tolist()
    return [(i, v) for i, v in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<float>, label int, node int, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def found(spark, rows, **more):
    result = embedding_links.near_duplicates(frame(spark, rows), **more).collect()
    for r in result:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    return Counter((r.vec_id, r.n_links, r.component_id) for r in result)


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_vectors_at_the_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.1]),
        (10, [0.0, 1.0]), (11, [1.0]), (12, [5.0]), (13, [-1.0, 0.0]), (None, [-3.0, -3.0]),
        (14, [1e30, 1e30]), (14, [1e-30, 0.0]),
    ]
    assert found(spark, rows) == Counter(brute_links(as_floats(rows)))
    assert found(spark, []) == Counter()


@pytest.mark.parametrize("leaf, sample", [(2_048, 16_384), (64, 4_096), (64, 512)])
def test_forest_against_all_pairs(spark, leaf, sample):
    rows = as_floats(clusters(5, 400, 6, 48, 0.92) + [(10**6 + i, v) for i, v in clusters(6, 1500, 1, 48, 0.5)])
    random.Random(1).shuffle(rows)
    expected = {i: (n, c) for i, n, c in brute_links(rows)}
    result = {i: (n, c) for i, n, c in found(spark, rows, leaf=leaf, sample=sample)}
    assert set(result) == set(expected)
    assert all(result[i][0] <= expected[i][0] for i in expected)
    total = sum(n for n, _ in expected.values())
    assert total > 5_000
    # A leaf of all rows is exact; so many more trees than one are not expected to be.
    least = 1.0 if leaf > len(rows) else embedding_links.RECALL
    assert sum(n for n, _ in result.values()) >= least * total


def test_dense_group_is_whole(spark):
    dense = clusters(7, 1, 1_500, 32, 0.95)
    rows = as_floats(dense + [(5_000 + i, v) for i, v in clusters(8, 800, 1, 32, 0.5)])
    rows += [(9_000 + i, rows[3][1]) for i in range(700)]
    assert found(spark, rows, leaf=128, sample=1_024) == Counter(brute_links(rows))


def test_trees_follow_the_number_of_vectors():
    trees = [embedding_links.trees_for(n, 2_048, 0.9) for n in (0, 2_048, 10**5, 10**8, 10**11)]
    assert trees[:2] == [1, 1] and trees == sorted(trees) and trees[2] < trees[3] < trees[4] < 100


# --- alignment -----------------------------------------------------------------


def brute_alignment(texts):
    """Per text: groups and links by comparing all byte ranges; then the corpus' counts."""
    tokens = alignment.ByteLevel(open(vocabulary(), encoding="utf-8").read())
    pieces = alignment.Pieces(open(public_tokenizers.path(PIECES), "rb").read())

    def library(text):
        return tokens.library.encode(" " + text, add_special_tokens=False).ids

    def ranges(ids, table):
        out, at = [], 0
        for code in ids:
            out.append((at, at + len(table[code]), code))
            at += len(table[code])
        return out

    made = []
    for text in texts:
        if not text:
            made.append(([], [], [], []))
            continue
        data = b" " + text.encode()
        a, b = library(text), pieces.encode(text)
        if b"".join(tokens.bytes[c] for c in a) != data or b"".join(pieces.bytes[c] for c in b) != data:
            made.append(([], [], [], []))
            continue
        ra, rb = ranges(a, tokens.bytes), ranges(b, pieces.bytes)
        links = [(x, y) for s, e, x in ra for t, u, y in rb if s < u and t < e]
        both = {e for _, e, _ in ra} & {e for _, e, _ in rb}
        groups, last = [], 0
        for end in sorted(both):
            inside = [[str(c) for s, e, c in side if s >= last and e <= end] for side in (ra, rb)]
            groups.append("|".join(map(",".join, inside)))
            last = end
        made.append((a, b, groups, links))
    held = Counter(pair for *_, links in made for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (
            len(a), len(b), len(groups), len(links),
            sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for a, b, groups, links in made
    ]


TEXTS = [
    None, "", " ", "  two  spaces ", "plain words here, as ever.", "plain words here, as ever.",
    "<|endoftext|> and <s>special</s> <unk>", "tab\tline\nfeed\r\n", "ümläut naïve 日本語 текст 🙂🙂",
    "▁low line", " nbsp　wide", "x" * 500, "camelCaseWords_and_underscores 1234567890 3.14159",
    "á combining", "ﬁ ligature", "\x00 nul", "<0x41> not a byte",
]


@pytest.mark.parametrize("hot", [0, 7, alignment.HOT])
def test_alignment_against_all_ranges(spark, words, hot):
    source = random.Random(2)
    texts = TEXTS + [words(source.randint(1, 40)) for _ in range(30)]
    rows = [(i, t, 3, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, row_id string").repartition(3)
    result = alignment.align_documents(docs, vocabulary(), public_tokenizers.path(PIECES), hot)
    by = {r.doc_id: r for r in result.collect()}
    for i, expected in enumerate(brute_alignment(texts)):
        r = by[i]
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        assert got == expected, texts[i]
        assert len(r.groups) == r.n_groups


# --- fill-in-middle ------------------------------------------------------------


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_the_definition(spark, words):
    source = random.Random(4)
    texts = [None, "", " ", "a", "<", "<P", "a<S>b", "S><M", "é🙂" * 50, "Zz[`@{" * 9, "line\nfeed\r"]
    texts += [words(source.randint(1, 60)) + "".join(source.choices("<>PSM é\n", k=9)) for _ in range(80)]
    # Containers of every kind, and a run of letters across their borders.
    texts += ["word " * 40_000, "-" * 150_000, "q" * 140_000 + "!" + "r" * 70_000, "é a" * 70_000, "x"]
    rows = [(None if i % 41 == 40 else i, t, "e", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    result = fill_middle.fill_in_middle(docs).withColumn(
        "restored", fill_middle.restored(F.col("output"), F.col("form"))
    )
    got = Counter(
        (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)
        for r in result.collect()
    )
    assert got == Counter((i, *brute_middle(i, t), t or "") for i, t, *_ in rows)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("kind", ["ArrayContainer", "BitmapContainer", "RunContainer"])
def test_containers_select_every_offset(kind):
    draw = np.random.default_rng(3)
    offsets = {
        "ArrayContainer": np.sort(draw.choice(1 << 16, 300, replace=False)),
        "BitmapContainer": np.sort(draw.choice(1 << 16, 30_000, replace=False)),
        "RunContainer": np.r_[5:9000, 10_000:40_000, 65_530:65_536],
    }[kind]
    made = fill_middle.container(offsets)
    assert type(made).__name__ == kind
    for k in [0, 1, len(offsets) // 2, len(offsets) - 1, *draw.integers(0, len(offsets), 40)]:
        assert made.select(int(k)) == offsets[k]


def test_ranks_give_the_ids_of_the_library():
    tokens = alignment.ByteLevel(open(vocabulary(), encoding="utf-8").read())
    assert tokens.ranks
    for start in range(0, 0x110000, 512):
        part = [chr(c) for c in range(start, start + 512) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b {c}1 {c}{c}! {c} 2{c}3" for c in part)
        expected = tokens.library.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        assert tokens.encode(text) == expected, hex(start)
