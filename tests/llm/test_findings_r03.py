"""Line dedup finds the lines that stay by numbers; texts are dealt out once."""

from decoylog.llm import line_dedup

REPEATED = "this line comes in more than one text"
NEARLY = "this line comes in more than one texts"


def test_lines_are_not_dealt_out_with_their_texts(docs_of, plans):
    plan_of, _ = plans
    texts = line_dedup.without_repeats(docs_of([(1, f"{REPEATED}\na"), (2, f"b\n{NEARLY}")]))
    assert "first(line" not in plan_of(texts)
    assert {r.doc_id: r.text for r in texts.collect()} == {1: f"{REPEATED}\na", 2: "b"}


def test_texts_without_lines_and_rows_that_repeat(docs_of):
    rows = [
        (None, f"x\n{REPEATED}\n\n"),
        (1, None),
        (1, ""),
        (2, f"{NEARLY}\ny"),
        (2, f"{NEARLY}\ny"),
        (2, f"z\r\n{REPEATED}\nz"),
        (3, REPEATED),
    ]
    found = line_dedup.without_repeats(docs_of(rows)).collect()
    # A null doc_id comes first; equal rows are one document and get the same text.
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in found), key=str) == sorted(
        [
            (None, f"x\n{REPEATED}\n\n", len(REPEATED) + 4),
            (1, None, None),
            (1, "", 0),
            (2, "y", 1),
            (2, "y", 1),
            (2, "z\r\nz", 4),
            (3, "", 0),
        ],
        key=str,
    )
