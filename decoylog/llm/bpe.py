"""Byte-pair encoding as a bounded-lookahead transducer, and incremental decoding.

Merges run in rank order, so what follows a text can change its codes only near
the end.  How near is a property of the merge list.  Compare two texts that
agree up to some byte: a merge (u, v) that is possible in one only moves the
first difference to the left by the length of u, and the next such move needs a
later merge (u', v') whose v' begins, down its left parts, with u.  The longest
chain of such merges is the *lookahead*: a code that ends at least that many
bytes before the end of what has been read is final, whatever follows.  The
transducer therefore keeps a window of the lookahead and some slack, emits what
is final, and drops it; its memory does not grow with the text.

Decoding maps codes to bytes and feeds them to an incremental UTF-8 decoder,
whose state holds at most three bytes between blocks.

Defined results: a null text is an empty one and gives no codes; text of a
special token gives that token's code, as the library's default does; repeated
rows each give their row.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-token pattern of this family of vocabularies.
_SPACE = r"\p{White_Space}"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"
)
#: Pre-tokens that a task remembers before it starts afresh.
REMEMBERED = 1 << 18
BLOCK_PIECES = 1 << 15
BLOCK_CODES = 1 << 15


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or the next letter after 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which no later byte can change a code; see the module's text."""
    longest: dict[bytes, int] = {}
    left_part: dict[bytes, bytes] = {}
    most = 0
    for u, v in merges:
        before, part = 0, v
        while part is not None:
            before = max(before, longest.get(part, 0))
            part = left_part.get(part)
        shift = len(u) + before
        most = max(most, shift)
        longest[u] = max(longest.get(u, 0), shift)
        left_part.setdefault(u + v, u)
    return most


def read_vocabulary(path: str) -> dict:
    """The plain data of a coder, of fixed size; ``known`` and ``counted`` fill in the tasks."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    alphabet = byte_alphabet()
    as_bytes = lambda s: bytes(alphabet[c] for c in s)
    codes = {as_bytes(token): code for token, code in data["model"]["vocab"].items()}
    merges = [
        tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m))
        for m in data["model"]["merges"]
    ]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    piece_bytes = {code: token for token, code in codes.items()}
    piece_bytes |= {code: text.encode() for text, code in special.items()}
    lookahead = sufficient_lookahead(merges)
    return {
        "single": [codes[bytes([b])] for b in range(256)],
        "pairs": {
            (codes[u], codes[v]): (rank, codes[u + v]) for rank, (u, v) in enumerate(merges)
        },
        "special": special,
        "piece_bytes": piece_bytes,
        "digits": {code: str(code) for code in piece_bytes},
        "lookahead": lookahead,
        "window": lookahead + 2 * max(map(len, codes)),
        "known": {},
        "counted": {},
    }


class Coder:
    """A vocabulary: merges by pair of codes, the bytes of each code, the lookahead."""

    def __init__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.pattern = regex.compile(PRE_TOKEN)
        # The longest first, should one special text begin another.
        texts = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, texts))) if texts else None

    def merged(self, data: bytes) -> list[int]:
        """Codes of a short run of bytes: the merge of least rank first, leftmost first."""
        codes = [self.single[b] for b in data]
        none = (1 << 60, 0)
        get = self.pairs.get
        ranks = [get(pair, none) for pair in zip(codes, codes[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == none[0]:
                break
            i = ranks.index(best)
            codes[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((codes[i], codes[i + 1]), none)
            if i:
                ranks[i - 1] = get((codes[i - 1], codes[i]), none)
        return codes

    def stream(self, data: bytes) -> Iterator[int]:
        """The transducer over one pre-token: codes leave as soon as they are final."""
        pending, at = b"", 0
        while at < len(data):
            part = data[at : at + self.window - len(pending)]
            pending, at = pending + part, at + len(part)
            if at == len(data):
                break
            final, end = len(pending) - self.lookahead, 0
            for code in self.merged(pending):
                size = len(self.piece_bytes[code])
                if end + size > final:
                    break
                end += size
                yield code
            pending = pending[end:]
        yield from self.merged(pending)

    def codes(self, piece: str) -> tuple[int, ...]:
        """Codes of a pre-token, remembered while the task has room."""
        found = self.known.get(piece)
        if found is None:
            data = piece.encode("utf-8", "surrogatepass")
            if len(data) > self.window:
                return tuple(self.stream(data))
            found = tuple(self.merged(data))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of plain text and the special tokens between them."""
        start = 0
        for match in self.special_pattern.finditer(text) if self.special_pattern else ():
            yield text[start : match.start()], self.special[match[0]]
            start = match.end()
        yield text[start:] if start else text, None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a stretch, in lists of bounded length."""
        if len(text) <= BLOCK_PIECES:
            yield self.pattern.findall(text)
            return
        found = (match[0] for match in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK_PIECES)):
            yield block

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """All codes of a text, in blocks."""
        for part, special in self.parts(text or ""):
            for block in self.pieces(part):
                yield list(chain.from_iterable(map(self.codes, block)))
            if special is not None:
                yield [special]

    def decode(self, blocks: Iterator[list[int]]) -> Iterator[str]:
        """The text of blocks of codes; a character cut by a block's end waits for the rest."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            yield machine.decode(b"".join(map(self.piece_bytes.__getitem__, block)))
        yield machine.decode(b"", final=True)


def _round_trip(coder: Coder, text: str | None, keep: bool) -> tuple:
    """n_tokens, digest of the codes, digest of the decoded text, the codes if kept."""
    total, kept = 0, []
    codes_hash, text_hash = hashlib.sha256(), hashlib.sha256()

    def seen() -> Iterator[list[int]]:
        nonlocal total
        for block in coder.encode(text):
            if block:
                joined = ",".join(map(coder.digits.__getitem__, block))
                codes_hash.update((f",{joined}" if total else joined).encode())
                total += len(block)
                if keep:
                    kept.extend(block)
                yield block

    for out in coder.decode(seen()):
        text_hash.update(out.encode())
    return total, codes_hash.hexdigest(), text_hash.hexdigest(), kept


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on demand, the ids of every row.

    The vocabulary file is read once, on the driver, and is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)

        def batch_of(doc_ids: list, made: list) -> pa.RecordBatch:
            n, codes, texts, ids = (list(column) for column in zip(*made))
            arrays = [
                pa.array(doc_ids, type=id_type),
                pa.array(n, type=pa.int64()),
                pa.array(codes),
                pa.array(texts),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(ids, type=pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            doc_ids, made, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                made.append(_round_trip(coder, text.as_py(), keep_ids))
                held += len(made[-1][3])
                if held >= 1 << 20:
                    yield batch_of(doc_ids, made)
                    doc_ids, made, held = [], [], 0
            if made:
                yield batch_of(doc_ids, made)

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, columns + (", ids array<int>" if keep_ids else "")
    )
