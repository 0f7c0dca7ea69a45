"""Each operator against a plain restatement of its definition on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from decoylog.llm import (
    bpe,
    decontaminate,
    license_scan,
    license_texts,
    line_dedup,
    quality_rules,
    repeats,
    simhash,
    token_counts,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def white_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def digest(data):
    return hashlib.sha256(data).hexdigest()


# --- SimHash ---------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    words = white_words(lower(text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs_of, words):
    source = random.Random(1)
    rows = []
    for i in range(60):
        text = words(source.randint(0, 80))
        rows += [(3 * i, text), (3 * i + 1, text + " " + words(1)), (3 * i + 2, text.upper())]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one two")]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    found = simhash.near_duplicates(docs_of(rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{p:016x}", find(i)) for i, p in prints.items()
    }


@pytest.mark.parametrize("dense", [False, True])
def test_trees_find_every_pair(dense, monkeypatch):
    source = np.random.default_rng(3)
    centres = source.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << source.integers(0, 64, (2000, 4 if dense else 2), dtype=np.uint64)
    values = centres[source.integers(0, 1 if dense else 40, 2000)]
    for column in flips.T:
        values = values ^ column
    values = np.unique(values)
    expected = {
        (min(a, b), max(a, b))
        for i, a in enumerate(values.tolist())
        for b in values[i + 1 :].tolist()
        if (a ^ b).bit_count() <= 2
    }
    tree = simhash.build_tree(values[::7], 4)
    shards = {}
    for shard, found, home in simhash.route(tree, values, 2):
        data, queries = shards.setdefault(shard, ([], []))
        data += found[home].tolist()
        queries += found.tolist()
    pairs = [
        pair
        for data, queries in shards.values()
        for a, b in simhash.pairs_within(
            np.array(data, dtype=np.uint64), np.array(queries, dtype=np.uint64), 2
        )
        for pair in zip(a.tolist(), b.tolist())
    ]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == expected


def test_long_texts_are_read_in_blocks(monkeypatch, words):
    text = words(4000)
    whole = simhash.fingerprint(text, 3)
    blocks = list(simhash.word_blocks(text.encode(), 100))
    assert [w for b in blocks for w in b] == text.encode().split()
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 64)
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (64,))
    assert simhash.fingerprint(text, 3) == whole == plain_fingerprint(text)


# --- decontamination ---------------------------------------------------------------


def plain_hits(rows, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        ws = find(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + window]), set()).add(str(item))
    out = {}
    for doc, text in rows:
        ws, hit, seen = find(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (key := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    seen |= windows[key]
        out[doc] = (len(ws), len(hit), sorted(seen))
    return out


def test_decontamination(spark, docs_of, words):
    source = random.Random(2)
    items = [(i, words(source.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "--"), (3, items[3][1]), (103, items[4][1].upper())]
    rows = [(0, None), (1, ""), (2, "?!")]
    for i in range(3, 80):
        parts = [words(source.randint(0, 20))]
        for _ in range(source.randint(0, 3)):
            ws = (source.choice(items)[1] or "").split()
            a = source.randint(0, len(ws))
            parts += [" , ".join(ws[a : source.randint(a, len(ws))]), words(source.randint(0, 4))]
        parts += [source.choice(items)[1] or ""]
        rows.append((i, " ".join(parts)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs_of(rows), benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found} == plain_hits(rows, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in found)


# --- repeated passages ----------------------------------------------------------------


def plain_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if (key := data[i : i + 100]) in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(key)
        runs = sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(gone)))
        rest = bytes(x for x, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), runs, digest(rest))
    return out


@pytest.mark.parametrize("crowd", [32_768, 2])
def test_repeats(docs_of, words, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    source = random.Random(4)
    base = [words(60) for _ in range(6)]
    rows = []
    for i in range(70):
        text = words(source.randint(0, 30))
        for _ in range(source.randint(0, 3)):
            passage = source.choice(base)
            a = source.randint(0, len(passage))
            text += passage[a : source.randint(a, len(passage))] + words(source.randint(0, 3))
        rows.append((i, text))
    rows += [(90, "a" * 400), (91, "a" * 130), (92, "ab" * 200), (93, None), (94, ""), (95, "é" * 99)]
    found = repeats.without_repeats(docs_of(rows)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == plain_repeats(rows)
    assert all(digest(bytes(r.kept)) == r.kept_sha256 for r in found)


def test_repeat_groups_list_all_occurrences(words):
    passage = words(30).encode()[:140]
    parts = [b"x" * 9 + passage + b"y" * 5, b"zz" + passage + b"q", b"k" + passage[:120] + b"!"]
    groups = [(n, sorted(m)) for n, m in repeats.repeat_groups(parts)]
    assert (140, [(0, 9), (1, 2)]) in groups
    assert (120, [(0, 9), (1, 2), (2, 1)]) in groups


def test_interval_tree_of_a_known_table():
    # mississippi: prefixes shared by neighbours in the suffix array
    lcp = [1, 1, 4, 0, 0, 1, 0, 2, 1, 3]
    assert sorted(repeats._intervals(lcp)) == [
        (1, 0, 3), (1, 5, 6), (1, 7, 10), (2, 7, 8), (3, 9, 10), (4, 2, 3),
    ]


# --- byte-pair codes ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab' \n\t!?é1<|endoftx>", max_size=120))
def test_codes_are_the_library_s(coder, library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    blocks = list(coder.encode(text))
    assert [c for b in blocks for c in b] == expected
    pieces = [[c] for c in expected]  # every character cut wherever a code ends
    assert "".join(coder.decode(iter(pieces))) == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "a", "er", "tion", "==", "é", "zq"]), min_size=400, max_size=900))
def test_long_pre_tokens_stream(coder, library, parts):
    text = "".join(parts)
    assert [c for b in coder.encode(text) for c in b] == library.encode(text).ids
    window = coder.window
    data = text.encode()
    assert len(data) > window and list(coder.stream(data)) == coder.merged(data)


def test_lookahead_is_that_of_the_merge_list():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    # b c may move the end of a, which decides whether x a merges
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b"), (b"x", b"a")]) == 3


def test_documents(docs_of, library):
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> wörld"), (4, "x" * 5000), (5, " \n\n a")]
    for r in bpe.encode_documents(docs_of(rows), PATH).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == digest(",".join(map(str, ids)).encode())
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False).encode())
    for r in token_counts.count_tokens(docs_of(rows), PATH, limit=3).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 3)


# --- lines ------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    source = random.Random(5)
    rows = []
    for _ in range(250):
        a = [source.choice("ab é") for _ in range(source.randint(0, 12))]
        b = list(a)
        for _ in range(source.randint(0, 4)):
            i = source.randint(0, len(b))
            b[i : i + source.randint(0, 1)] = source.choice([[], ["a"], ["é"], ["b"]])
        rows.append(("".join(a), "".join(b)))
    pairs = spark.createDataFrame(rows, "a string, b string")
    for r in pairs.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), most).alias("w")).collect():
        assert r.w == (edit_distance(r.a, r.b) <= most), (r.a, r.b)


def plain_lines(rows):
    places = sorted(
        (doc, pos, line)
        for doc, text in rows
        if text is not None
        for pos, line in enumerate(text.split("\n"))
    )
    first, gone = set(), set()
    for doc, pos, line in places:
        if not line.strip(BLANK):
            continue
        near = len(line) >= 20 and any(
            len(m) >= 20 and abs(len(m) - len(line)) <= 1 and edit_distance(m, line) <= 1
            for m in first
        )
        if line in first or near:
            gone.add((doc, pos))
        first.add(line)
    return gone


@pytest.mark.parametrize("crowd", [64, 3])
def test_lines(docs_of, words, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    source = random.Random(6)
    base = [words(5)[:40] for _ in range(30)]

    def edited(line):
        chars = list(line)
        for _ in range(source.randint(0, 2)):
            i = source.randint(0, max(0, len(chars) - 1))
            chars[i : i + source.randint(0, 1)] = source.choice([[], ["z"], ["é"]])
        return "".join(chars)

    kinds = [lambda: "", lambda: " \t", lambda: edited(source.choice(base)), lambda: source.choice(base),
             lambda: f"user {source.randint(0, 3000):05d} signed in at noon"]
    rows = [(i, "\n".join(source.choice(kinds)() for _ in range(source.randint(0, 10)))) for i in range(90)]
    rows += [(200, None), (201, "short"), (202, "shorx")]
    gone = plain_lines(rows)
    docs = docs_of(rows)
    report = line_dedup.line_report(docs).collect()
    assert {(r.doc_id, p) for r in report for p in r.removed} == gone
    texts = line_dedup.without_repeats(docs)
    assert texts.columns == docs.columns
    for r in texts.collect():
        text = dict(rows)[r.doc_id]
        kept = None if text is None else "\n".join(
            line for pos, line in enumerate(text.split("\n")) if (r.doc_id, pos) not in gone
        )
        assert r.text == kept and r.n_chars == (None if kept is None else len(kept))


def test_no_python_in_native_plans(docs_of, plans, words):
    docs = docs_of([(i, words(60)) for i in range(4)])
    for found in (
        line_dedup.line_report(docs), license_scan.scan(docs), quality_rules.judge(docs)
    ):
        assert not re.search("Python|Arrow|Pandas", plans[0](found))


# --- quality rules ---------------------------------------------------------------------------------


def plain_counts(text):
    ws = white_words(text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.strip(BLANK)]
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(hit),
    )


def test_base_counts(docs_of, words):
    source = random.Random(7)
    rows = [(0, None), (1, ""), (2, " \x1f\x0b"), (3, "a b c"), (4, "a b c a b c"), (5, "a a a a")]
    for i in range(6, 60):
        line = words(source.randint(0, 6)) + source.choice(["", "|", "##", "é"])
        rows.append((i, "\n".join(source.choice([line, words(4), " "]) for _ in range(source.randint(1, 9)))))
    found = quality_rules.judge(docs_of(rows)).collect()
    for r in found:
        expected = plain_counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r.base_failed == failed and not (failed and r.kept)


def plain_mcd(rows):
    """The same estimate in numpy: groups of vectors to (mean, scatter)."""
    p = len(quality_rules.STATS)
    floors = np.diag(np.square(quality_rules.FLOORS))
    middle = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]

    def start(x):
        quartiles = np.array([[middle(c, q) for q in (0.25, 0.5, 0.75)] for c in x.T])
        return quartiles[:, 1], np.diag(((quartiles[:, 2] - quartiles[:, 0]) / 1.349) ** 2)

    def blended(own, everywhere):
        out = {}
        for key, (n, mean, cov) in own.items():
            w = n / (n + quality_rules.PRIOR_ROWS)
            out[key] = (w * mean + (1 - w) * everywhere[0], w * cov + (1 - w) * everywhere[1] + floors)
        return out

    distance = lambda x, m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    params = blended({k: (len(x), *start(x)) for k, x in rows.items()}, start(np.vstack(list(rows.values()))))
    cut = quality_rules.chi_square_cut(1 - quality_rules.SUPPORT, p)
    scale = quality_rules.SUPPORT / quality_rules.chi_square_cdf(cut, p + 2)
    for _ in range(quality_rules.STEPS):
        own = {}
        for key, x in rows.items():
            d = distance(x, *params[key])
            core = x[d <= middle(d, quality_rules.SUPPORT) * (1 + 1e-12)]
            own[key] = (len(core), core.mean(0), np.cov(core.T, bias=True).reshape(p, p) * scale)
        total = sum(n for n, _, _ in own.values())
        everywhere = tuple(sum(v[0] * v[i] for v in own.values()) / total for i in (1, 2))
        params = blended(own, everywhere)
    return {key: distance(x, *params[key]) for key, x in rows.items()}


def test_outliers_against_numpy(docs_of, words):
    source = random.Random(8)
    rows = [
        (i, words(source.randint(55, 300)), source.choice(["en", "de"]), source.choice(["a", "b"]))
        for i in range(200)
    ]
    rows += [(500, " ".join("x$%&" for _ in range(80)), "en", "a"), (501, words(80), None, None)]
    found = quality_rules.with_statistics(quality_rules.base_counts(docs_of(rows))).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.lang, r.source), []).append((r.doc_id, [r[s] for s in quality_rules.STATS]))
    expected = {}
    distances = plain_mcd({k: np.array([v for _, v in g]) for k, g in groups.items()})
    for key, group in groups.items():
        expected |= dict(zip((i for i, _ in group), distances[key]))
    judged = {r.doc_id: r for r in quality_rules.judge(docs_of(rows)).collect()}
    for i, d in expected.items():
        assert judged[i].distance2 == pytest.approx(d, rel=1e-6)
    assert not judged[500].kept and judged[501].kept
    assert sum(r.kept for r in judged.values()) == 201


# --- licences --------------------------------------------------------------------------------------


def test_licences_in_any_layout(spark, docs_of):
    mit, bsd = license_texts.KNOWN["MIT"], license_texts.KNOWN["BSD-3-Clause"]
    rows = [
        (1, mit),
        (2, "MIT Licence\r\n\r\nCopyright (c) 2020 Someone\r\n" + mit.split("\n", 1)[1].replace("\n", "\r\n")),
        (3, "# " + bsd.upper().replace("\n", "\n# ")),
        (4, " ".join(bsd.replace("copyright holder nor", "copyright owner nor").split())),
        (5, bsd.replace(" ", "\n")),
        (6, mit + " and more"),
        (7, "prose that names the MIT License"),
        (8, None),
        (9, " -- "),
    ]
    found = {r.doc_id: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert {i: r.license_id for i, r in found.items()} == {
        1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: "BSD-3-Clause",
        6: None, 7: None, 8: None, 9: None,
    }
    assert found[8].digest is None and found[9].digest is None and found[7].digest
    known = license_scan.known_digests(spark)
    assert known.count() == known.select("license_digest").distinct().count() == len(license_texts.KNOWN)
