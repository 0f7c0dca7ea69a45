"""Cases of the review of round 2: what an operator once left out."""

import math
import random
from pathlib import Path

import pytest

from decoylog.llm import license_scan, line_dedup, quality_rules


def _lines(source, words, n, repeated):
    """``n`` lines of ten words, a share of which repeat one of the others."""
    own = [words(10, source) for _ in range(n - int(n * repeated))]
    return "\n".join(own + [source.choice(own) for _ in range(int(n * repeated))])


# --- op10: each statistic rejects by itself ------------------------------------


def test_each_statistic_rejects_moderately_bad_documents(docs_of, words):
    source = random.Random(21)
    rows = [(i, _lines(source, words, source.randint(10, 40), 0)) for i in range(300)]
    prose = words(200, source).split()
    rows += [
        (1000, " ".join(w + ("$" if i % 7 == 0 else "") for i, w in enumerate(prose))),
        (1001, " ".join(w * 3 for w in prose)),
        (1002, "\n".join([words(2, source)] * 60 + [words(400, source)])),
        (1003, " ".join(prose[:140] + prose[:44])),
        (1004, " ".join(w + ("$" if i % 50 == 0 else "") for i, w in enumerate(prose))),
        (1005, _lines(source, words, 40, 0.05)),
    ]
    found = {r.doc_id: r for r in quality_rules.judge(docs_of(rows)).collect()}
    assert not any(found[i].base_failed for i in range(1000, 1006))
    assert [found[i].kept for i in range(1000, 1006)] == [False] * 4 + [True] * 2
    assert sum(found[i].kept for i in range(300)) >= 297


@pytest.mark.parametrize("bad", range(len(quality_rules.STATS))[2:])
def test_highest_value_of_a_share_is_beyond_the_cutoff(bad):
    cutoff = quality_rules.chi_square_cut(quality_rules.TAIL, len(quality_rules.STATS))
    # Ten per cent of symbols; all lines of ten words alike; the base rule's repeats.
    highest = {2: 10.0, 3: 9.0, 4: 49.0}[bad]
    assert (math.log1p(highest) / quality_rules.FLOORS[bad]) ** 2 > cutoff


# --- op8: a crowded line is never held once per character ----------------------


def test_crowded_lines_are_shortened_after_the_explode(spark, plans):
    rows = [((1, 1, 0), "x" * 3000 + "a"), ((2, 2, 0), "x" * 3000 + "b"), ((3, 3, 0), "x" * 3000)]
    schema = "at struct<doc_id: long, text_key: long, pos: int>, line string"
    found = line_dedup._crowded(spark.createDataFrame(rows, schema))
    assert "transform(" not in plans[0](found)
    assert {r["at"].doc_id for r in found.distinct().collect()} == {2, 3}


# --- op9: longer licences as whole texts -----------------------------------------

TEXTS = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not TEXTS.is_dir(), reason="no licence texts on this machine")
def test_whole_longer_licences(docs_of):
    files = {1: "Apache-2.0", 2: "GPL-2", 3: "GPL-3", 4: "LGPL-2.1", 5: "MPL-2.0", 6: "CC0-1.0"}
    texts = {i: (TEXTS / name).read_text() for i, name in files.items()}
    rows = [(i, text.replace("\n", "\r\n")) for i, text in texts.items()]
    rows += [(7, texts[3] + " and more"), (8, texts[1].split("APPENDIX")[0])]
    found = {r.doc_id: r.license_id for r in license_scan.scan(docs_of(rows)).collect()}
    assert found == {
        1: "Apache-2.0", 2: "GPL-2.0", 3: "GPL-3.0", 4: "LGPL-2.1", 5: "MPL-2.0", 6: "CC0-1.0",
        7: None, 8: "Apache-2.0 (terms)",
    }
