"""Alignment of two tokenizers' tokens, byte by byte.

Both tokenizers encode a text; each token covers a range of its bytes.  The
cumulative ends of both token lists are dictionaries from end to index.  The ends
that both have, the sorted intersection of the dictionaries' keys, slice both id
lists into groups.  Within a group no other ends agree, so its links (pairs of
overlapping tokens) are found by walking both sides once.

Texts are aligned by units, each of which is white space and what follows it up to
the next white space that is not a carriage return.  Both tokenizers end a token where
a unit ends: the pattern of A's family does, and no piece of B has such white space
after anything else.  So a task aligns the units it has not met as one text, remembers
the short ones, and puts texts together from them.  Pairs of vocabularies without that
property align whole texts.

A pair of ids counts the documents that hold it linked.  Every task counts its own
documents first, so the shuffle moves one row per pair and batch.  The counts go
back to the documents in two ways: those of the ``HOT`` most frequent pairs, a
table of fixed size, are looked up where the documents are; other pairs are joined.
No key of that join is frequent, so it has no hot task, and results are the same
whatever ``HOT`` is.

Defined results: null and empty texts, and those a tokenizer does not give back
byte by byte, have no tokens and no links; repeated rows are documents of their
own; a null ``doc_id`` keeps its row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from decoylog.llm.bpe import byte_alphabet
from decoylog.session import run_dir

#: Pairs whose counts are handed to every task.
HOT = 1 << 17
#: Characters and documents given out at a time.
BLOCK, OUT = 1 << 20, 512
#: Groups a task remembers, by kind.
REMEMBERED = 1 << 17
#: Units a task remembers, the characters such a unit may have, and of new ones aligned at a time.
UNITS, SHORT, TOGETHER = 1 << 18, 32, 1 << 14
#: What A's pattern takes for white space; a unit; what no piece may hold to be read by units.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf"[{WHITE}]*[^{WHITE}]+(?:\r[{WHITE}]*[^{WHITE}]+)*(?:\r[{WHITE}]*)?|[{WHITE}]+")
INNER_WHITE = re.compile(rf"[^{WHITE}](?!\r)[{WHITE}]")
# Fixed value: how this family of vocabularies cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on are left to the library.
WHITE_RUN = 4_096
LONG_WHITE = re.compile(r"\s{%d}" % WHITE_RUN)


def too_white(text: str) -> bool:
    """Whether the rank coder cannot take the text."""
    return len(text) >= WHITE_RUN and LONG_WHITE.search(text) is not None


class ByteLevel:
    """A byte-level vocabulary (JSON of the tokenizers library); special texts are plain text.

    Where merges are numbered in rank order and texts are cut by the usual pattern,
    the vocabulary is read as ranks, which gives the same ids with less work.  The
    rank coder cannot take very long runs of white space; the library itself can.
    """

    def __init__(self, definition: str) -> None:
        self.definition = definition
        self._library: Tokenizer | None = None
        data = json.loads(definition)
        alphabet = byte_alphabet()
        vocabulary = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for entry, code in (special | vocabulary).items():
            plain = entry not in special and all(c in alphabet for c in entry)
            self.bytes[code] = bytes(alphabet[c] for c in entry) if plain else entry.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        merged = [vocabulary[a + b] for a, b in merges]
        cut = data["pre_tokenizer"] or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut["add_prefix_space"]
        ordered = all(a < b for a, b in zip(merged, merged[1:]))
        self.ranks = None
        if usual and ordered and not data["normalizer"]:
            ranks = {self.bytes[code]: code for e, code in vocabulary.items() if e not in special}
            self.ranks = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_str(self.definition)
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def encode(self, text: str) -> list[int]:
        spaced = " " + text
        if self.ranks and not too_white(spaced):
            return self.ranks.encode_ordinary(spaced)
        return self.library.encode_batch_fast([spaced], add_special_tokens=False)[0].ids


class Pieces:
    """A piece model with byte fallback, which puts a space before the text."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        made = sentencepiece_model_pb2.ModelProto.FromString(model)
        texts, kinds = made.normalizer_spec, {p.type for p in made.pieces}
        # Merges look at neighbours alone, so units that share no piece do not meet.
        self.by_unit = (
            made.trainer_spec.model_type == made.trainer_spec.BPE
            and not made.trainer_spec.treat_whitespace_as_suffix
            and texts.name == "identity"
            and not texts.precompiled_charsmap
            and texts.add_dummy_prefix
            and texts.escape_whitespaces
            and not texts.remove_extra_whitespaces
            and not kinds & {made.SentencePiece.USER_DEFINED, made.SentencePiece.UNUSED}
            and not any(INNER_WHITE.search(p.piece.replace("▁", " ")) for p in made.pieces)
        )

    def _bytes(self, code: int) -> bytes:
        piece = self.model.id_to_piece(code)
        if self.model.is_byte(code):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def sides(a: Sequence[int], b: Sequence[int], len_a: list[int], len_b: list[int]) -> Iterator[tuple[int, int]]:
    """Overlapping pairs of a group whose sides cover the same bytes, in order."""
    i = j = 0
    end_a, end_b = len_a[a[0]], len_b[b[0]]
    while True:
        yield a[i], b[j]
        if end_a == end_b:
            return
        if end_a < end_b:
            i += 1
            end_a += len_a[a[i]]
        else:
            j += 1
            end_b += len_b[b[j]]


class Aligner:
    """Groups and links of two id lists over the same bytes."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]) -> None:
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.sizes_a, self.sizes_b = list(map(len, bytes_a)), list(map(len, bytes_b))
        self.len_a, self.len_b = np.array(self.sizes_a), np.array(self.sizes_b)
        self.digits = list(map(str, range(max(len(bytes_a), len(bytes_b)))))
        self.width = len(bytes_b)
        #: Groups of one token on each side, by link.
        self.ones: dict[int, str] = {}
        #: Other groups, with their links.
        self.several: dict[tuple, tuple[str, list[int]]] = {}

    def gives_back(self, b: list[int], data: bytes) -> bool:
        """Whether B's tokens are the text; A's are, as byte-level merging loses nothing."""
        return b"".join(map(self.bytes_b.__getitem__, b)) == data

    def _several(self, key: tuple[tuple[int, ...], tuple[int, ...]]) -> tuple[str, list[int]]:
        if len(self.several) >= REMEMBERED:
            self.several.clear()
        left, right = (",".join(map(self.digits.__getitem__, x)) for x in key)
        linked = [x * self.width + y for x, y in sides(*key, self.sizes_a, self.sizes_b)]
        made = f"{left}|{right}", linked
        # Long ones hardly come again.
        if len(linked) <= 16:
            self.several[key] = made
        return made

    def _one(self, link: int) -> str:
        if len(self.ones) >= REMEMBERED:
            self.ones.clear()
        made = self.ones[link] = "%s|%s" % tuple(map(self.digits.__getitem__, divmod(link, self.width)))
        return made

    def align(
        self, a: list[int], b: list[int]
    ) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The groups as text and their ends, each link as one number and its group.

        The number of a link is its A id times B's ids, plus its B id.
        """
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_b = np.cumsum(self.len_b[ids_b])
        at_a = dict(zip(np.cumsum(self.len_a[ids_a]).tolist(), range(1, len(a) + 1)))
        # B's dictionary is its ends in order, so probing A's with them one after the
        # other gives the intersection of the keys, and gives it sorted.
        found = np.fromiter(map(at_a.get, ends_b.tolist(), repeat(0)), np.int64, len(b))
        to_b = np.flatnonzero(found) + 1
        to_a = found[to_b - 1]
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        single = (size_a == 1) & (size_b == 1)
        links = ids_a[to_a - 1] * self.width + ids_b[to_b - 1]
        groups = list(map(self.ones.get, links.tolist()))
        more: list[int] = []
        sizes: list[int] = []
        wide = np.flatnonzero(~single)
        for g, i, j, k, m in zip(*(x.tolist() for x in (
            wide, (to_a - size_a)[wide], to_a[wide], (to_b - size_b)[wide], to_b[wide]
        ))):
            key = (tuple(a[i:j]), tuple(b[k:m]))
            groups[g], linked = self.several.get(key) or self._several(key)
            more += linked
            sizes.append(len(linked))
        if None in groups:
            for g in [g for g, group in enumerate(groups) if group is None]:
                groups[g] = self._one(int(links[g]))
        of = np.concatenate([np.flatnonzero(single), np.repeat(wide, np.array(sizes, np.int64))])
        return groups, ends_b[to_b - 1], np.concatenate([links[single], np.array(more, np.int64)]), of


class Units:
    """What a task knows of units: the groups as text, the numbers of tokens, the links.

    All of it is kept by place.  Places of long units and of whole texts are given up
    after each block; all are when ``most`` units are remembered.
    """

    def __init__(self, tokens: ByteLevel, pieces: Pieces, most: int = UNITS) -> None:
        self.tokens, self.pieces, self.most = tokens, pieces, most
        self.aligner = Aligner(tokens.bytes, pieces.bytes)
        self.by_unit = tokens.ranks is not None and pieces.by_unit
        self.span = len(tokens.bytes) * len(pieces.bytes)
        self._forget(0)

    def _forget(self, place: int) -> None:
        """Gives up the places from this one on."""
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not place:
            self.places: dict[str, int] = {}
            self.groups: list[str] = []
            #: Tokens of A, tokens of B and groups by place; the links of a place, from its start on.
            self.counts, self.starts = np.empty((0, 3), np.int64), np.zeros(1, np.int64)
            self.links = np.empty(0, np.int64)
        elif place < len(self.groups):
            del self.groups[place:]
            self.counts, self.starts = self.counts[:place], self.starts[: place + 1]
            self.links = self.links[: self.starts[-1]]

    def _align(self, text: str, ends: Sequence[int] | None = None) -> bool:
        """Aligns a text, and gives a place to each part after the first end, or to all.

        ``ends`` count bytes of the text and the space before it.  False if the text is
        not given back, or if a part does not end where a group does.
        """
        a, b = self.tokens.encode(text), self.pieces.encode(text)
        data = b" " + text.encode()
        if not self.aligner.gives_back(b, data):
            return False
        groups, at, links, of = self.aligner.align(a, b)
        first = ends is not None
        ends = np.array(ends if first else [len(data)], np.int64)
        if (at[np.searchsorted(at, ends)] != ends).any():
            return False

        def parts(upto: np.ndarray) -> np.ndarray:
            """How many of these ends each part has."""
            return np.diff(np.searchsorted(upto, ends, "right"), prepend=0)

        aligner = self.aligner
        ends_a, ends_b = np.cumsum(aligner.len_a[np.array(a)]), np.cumsum(aligner.len_b[np.array(b)])
        counts = np.stack([parts(ends_a), parts(ends_b), parts(at)], 1)[first:]
        until = np.cumsum(parts(at)).tolist()
        self.groups += [";".join(groups[i:j]) for i, j in zip([0, *until][first:], until[first:])]
        part = np.searchsorted(ends, at)[of]
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=len(ends))
        self.fresh.append((counts, sizes[first:], links[order][sizes[0] if first else 0 :]))
        return True

    def _settle(self) -> None:
        """Puts what was aligned since the last call to the rest."""
        if self.fresh:
            counts, sizes, links = map(np.concatenate, zip(*self.fresh))
            self.counts = np.concatenate([self.counts, counts])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.links = np.concatenate([self.links, links])
            self.fresh = []

    def _meet(self, units: list[str]) -> bool:
        """Gives places to units; only the last may end in white space."""
        size = len(self.groups)
        ends = np.cumsum([2, *(len(u.encode()) for u in units)])
        # All units begin with white space: a letter before them makes them parts of a text.
        if not self._align("x" + "".join(units), ends):
            return False
        self.places.update(zip(units, range(size, size + len(units))))
        return True

    def _new(self, units: list[str]) -> bool:
        run, size = [], 0
        for unit in units:
            run.append(unit)
            size += len(unit)
            if size >= TOGETHER or unit[-1].isspace():
                if not self._meet(run):
                    return False
                run, size = [], 0
        return not run or self._meet(run)

    def _units(self, text: str | None) -> list[str]:
        """The units of a space and the text; none if it is aligned whole."""
        # This character is white space to B alone.
        if not text or not self.by_unit or "▁" in text:
            return []
        spaced = " " + text
        return [] if too_white(spaced) else UNIT.findall(spaced)

    def block(
        self, texts: list[str | None]
    ) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups and n_links, and the groups as text.

        Then the offsets of each text's distinct pairs, the pairs and how often they come.
        """
        if len(self.places) >= self.most:
            self._forget(0)
        cut = list(map(self._units, texts))
        unknown = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.places]
        short = [u for u in unknown if len(u) <= SHORT]
        long = [u for u in unknown if len(u) > SHORT]
        held = len(self.groups)
        if self._new(short):
            held = len(self.groups)
            if not self._new(long):
                cut = [[] for _ in texts]
        else:
            cut = [[] for _ in texts]
        places = [list(map(self.places.__getitem__, units)) for units in cut]
        for text, found in zip(texts, places):
            if text and not found and self._align(text):
                found.append(len(self.groups) - 1)
        self._settle()
        made = self._put_together(places)
        for unit in unknown:
            if self.places.get(unit, -1) >= held:
                del self.places[unit]
        self._forget(held)
        return made

    def _put_together(
        self, places: list[list[int]]
    ) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        groups = [";".join(map(self.groups.__getitem__, found)) for found in places]
        until = np.cumsum([0, *map(len, places)])
        at = np.fromiter(chain.from_iterable(places), np.int64, until[-1])
        sizes = np.diff(self.starts)[at]
        counts = np.column_stack([self.counts[at], sizes])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts, axis=0)])[until]
        # The links of all places in a row, under the number of their text.
        skipped = self.starts[at] - (np.cumsum(sizes) - sizes)
        links = self.links[np.repeat(skipped, sizes) + np.arange(sums[-1, 3])]
        totals = np.diff(sums, axis=0)
        text = np.repeat(np.arange(len(places)), totals[:, 3])
        keys, times = np.unique(text * self.span + links, return_counts=True)
        of, pairs = np.divmod(keys, self.span)
        return totals, groups, np.searchsorted(of, np.arange(len(places) + 1)), pairs, times


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of bounded length: (place of the first, texts); one text is never cut."""
    start, part, size = 0, [], 0
    for at, text in enumerate(texts):
        found = text.as_py()
        if part and (size + len(found or "") > BLOCK or len(part) >= OUT):
            yield start, part
            start, part, size = at, [], 0
        part.append(found)
        size += len(found or "")
    if part:
        yield start, part


_ALIGNED = (
    "row_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs array<bigint>, times array<int>"
)


def _aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> tuple[DataFrame, int]:
    """Every row with its digest and its distinct pairs; the number of B's ids."""
    with open(path_a, encoding="utf-8") as file:
        definition = file.read()
    with open(path_b, "rb") as file:
        model = file.read()
    # Two vocabulary files, of fixed size.
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(ByteLevel(shared.value[0]), Pieces(shared.value[1]))
        for batch in batches:
            for start, texts in blocks(batch.column("text")):
                totals, groups, offsets, pairs, times = known.block(texts)
                part = batch.slice(start, len(texts))
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                offsets = pa.array(offsets, pa.int32())
                arrays = [
                    part.column("doc_id"),
                    part.column("row_id"),
                    *map(pa.array, totals.T.copy()),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ]
                if keep_groups:
                    lists = [g.split(";") if g else [] for g in groups]
                    arrays.append(pa.array(lists, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "row_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    if keep_groups:
        names.append("groups")
    schema = f"doc_id {kind}, {_ALIGNED}" + (", groups array<string>" if keep_groups else "")
    text = F.col("text").cast("string").alias("text")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), text)
    width = Pieces(model).model.get_piece_size()
    return rows.mapInArrow(run, schema), width


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it linked) and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    partial = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    id_a = F.floor(F.col("pair") / width)
    most = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", id_a).join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def _scored(aligned: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """row_id, n_best and count_sum, in parts: from the hot pairs and from the others."""
    spark = aligned.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(hot).toArrow()
    arrays = [top[name].to_numpy() for name in ("pair", "n", "best")]
    order = np.argsort(arrays[0])
    shared = spark.sparkContext.broadcast([a[order] for a in arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            lists = batch.column(1)
            pairs, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            at, of, t = at[known], rows[known], times[known]
            np.add.at(sums, of, t * n[at])
            np.add.at(bests, of, t * best[at])
            lengths = np.bincount(rows[~known], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(bests),
                    pa.array(sums),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs[~known])),
                    pa.ListArray.from_arrays(offsets, pa.array(times[~known])),
                ],
                names=["row_id", "n_best", "count_sum", "pairs", "times"],
            )

    return aligned.select("row_id", "pairs", "times").mapInArrow(
        run, "row_id bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    )


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, hot: int = HOT, keep_groups: bool = True
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    With ``keep_groups`` also ``groups``, a text per group: A ids, a bar, B ids.
    """
    spark = docs.sparkSession
    folder = run_dir(spark, "alignment")
    made, width = _aligned(docs, path_a, path_b, keep_groups)
    made.write.option("compression", "zstd").parquet(f"{folder}/aligned")
    aligned = spark.read.parquet(f"{folder}/aligned")
    pair_counts(aligned, width).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    _scored(aligned, counts, hot).write.option("compression", "zstd").parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    rare = scored.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("at")).select(
        "row_id", "at.*"
    )
    times = F.col("times")
    joined = (
        rare.join(counts.withColumnRenamed("pair", "pairs"), "pairs")
        .select("row_id", F.when(F.col("best"), times).otherwise(0).alias("b"), (times * F.col("n")).alias("s"))
    )
    parts = scored.select("row_id", F.col("n_best").alias("b"), F.col("count_sum").alias("s"))
    totals = parts.unionByName(joined).groupBy("row_id").agg(
        F.sum("b").alias("n_best"), F.sum("s").alias("count_sum")
    )
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.drop("pairs", "times").join(totals, "row_id").select(
        *out, *(["groups"] if keep_groups else [])
    )
