"""Best-fit packing of tokenized documents into sequences by a configuration linear program.

Documents become token ids with an end id, cut into pieces only where they are longer than a sequence. What the program
sees is the histogram of piece lengths, at most `capacity` numbers. Its variables are configurations, multisets of
lengths that fit into one sequence; multiplicative weights on the lengths price them, a knapsack dynamic program finds the
configuration worth most, and each round takes some of it. Rounded down, the configurations become sequences; the pieces
that rounding leaves over fill them and new ones by best fit. Pieces then get their places by their rank among the pieces
of one length, in two levels of hash buckets, so that a common length never lies in one task.

Defined cases: null and empty texts give a piece with the end id alone; repeated rows are packed each for itself.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shizuku.llm.common import give_back, saved, small

#: Tokens in a sequence, the id that ends a document, rounds of the program, words whose ids a worker keeps.
CAPACITY, END, ROUNDS, KEPT = 4096, 1, 100, 300_000
#: Pieces of one length that are ranked together, about.
RANKED = 20_000
#: White space where Python's str.split and the tokenizer's patterns agree; texts with other control or odd space go the long way.
_ODD = [chr(i) for i in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B, 0xFEFF)]


class Encoder:
    """Token ids of whole texts, those of the tokenizer file.

    The tokenizer works on words between white space, so a word's ids are kept and used again. For byte-pair files with
    word ends, new words of ASCII and Latin-1 letters take a shorter way to the same ids: the merges run directly on their
    bytes, where an end mark, the byte 255 that UTF-8 never has, stands for the word end. All else goes through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.merge = self.pattern = None
        with open(path, encoding="utf-8") as f:
            self.shortcut(json.load(f))

    def shortcut(self, file: dict) -> None:
        model, kinds = file["model"], [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
        split = ((file["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split.get("invert"):
            return
        import regex
        import tiktoken

        # The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for themselves, the others count up from 256.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        raw = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>")
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(vocab[a + b] != 512 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 512 + len(merges):
            return  # ids don't tell the order of the merges
        ranks = {raw(t): i for t, i in vocab.items()}
        spare = len(ranks) + len(self.special)
        ranks |= {bytes([b]): spare + b for b in range(256) if bytes([b]) not in ranks}
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(split["pattern"]["Regex"])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if self.merge is None or not word.isascii() and max(word) > "\xff" or "<|" in word:
            return self.whole(word)
        low = word.lower()
        parts = [low] if low.isalpha() else self.pattern.findall(low)
        ids = [i for p in parts for i in self.merge(p.encode() + b"\xff")]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> np.ndarray:
        if any(c in text for c in _ODD):
            return np.frombuffer(self.whole(text), "<u4")
        words = text.split()
        try:
            got = list(map(self.kept.__getitem__, words))
        except KeyError:
            if len(self.kept) > KEPT:
                self.kept.clear()
            kept = self.kept
            for w in words:
                if w not in kept:
                    kept[w] = self.word(w)
            got = list(map(kept.__getitem__, words))
        return np.frombuffer(b"".join(got), "<u4")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        stop = np.array([end], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.ids(text), stop]) if text else stop
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((key, i, at, len(part), zlib.crc32(part.tobytes())))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names)) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=list(names))
        encoder.kept.clear()
        del encoder
        give_back()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(prices: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length of the most valuable configuration whose counts don't pass `left`. prices: by length, 0 for lengths not there.

    The dynamic program is over filled tokens without bounds on counts; a configuration that takes more of a length than
    is left is cut back, and the space is filled by the best of the rest.
    """
    lengths = np.flatnonzero((prices > 0) & (left > 0))
    counts = np.zeros(capacity + 1, np.int64)
    room = capacity
    while len(lengths) and room >= lengths[0]:
        value = np.zeros(room + 1)
        choice = np.full(room + 1, -1, np.int64)
        worth = prices[lengths]
        for c in range(int(lengths[0]), room + 1):
            n = np.searchsorted(lengths, c, "right")
            sums = value[c - lengths[:n]] + worth[:n]
            k = int(sums.argmax())
            if sums[k] > value[c - 1]:
                value[c], choice[c] = sums[k], k
            else:
                value[c] = value[c - 1]
        got = np.zeros(capacity + 1, np.int64)
        c = room
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                length = int(lengths[choice[c]])
                got[length] += 1
                c -= length
        got = np.minimum(got, left - counts)
        if not got.any():
            break
        counts += got
        room = capacity - int(counts @ np.arange(capacity + 1))
        lengths = lengths[(counts < left)[lengths] & (lengths <= room)]
    return counts


def configurations(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = 0.6) -> list[tuple[int, dict[int, int]]]:
    """(how often, counts by length): a packing of the whole histogram, whose index is the length.

    Multiplicative weights: a length's weight falls with the share of it that is covered, so that lengths that lag are
    worth more; its price is its weight times the length, a piece's part of the volume. Each round the dynamic program's
    best configuration is taken as often as `step` of what is left of its scarcest length allows.
    """
    histogram = histogram.astype(np.int64)
    size = np.arange(capacity + 1)
    left = histogram.copy()
    packed: list[tuple[int, dict[int, int]]] = []

    def take(counts: np.ndarray, times: int) -> None:
        left[:] -= counts * times
        at = np.flatnonzero(counts)
        packed.append((times, dict(zip(at.tolist(), counts[at].tolist(), strict=True))))

    if left[capacity]:
        counts = np.zeros(capacity + 1, np.int64)
        counts[capacity] = 1
        take(counts, int(left[capacity]))
    for _ in range(rounds):
        if int(left @ size) < 4 * capacity:
            break
        covered = 1 - left / np.maximum(histogram, 1)
        weight = np.exp(-0.5 * covered) * (left > 0)
        # Long pieces are the hard ones to place: per token they are worth a little more, so short ones stay for the gaps.
        counts = knapsack(weight * size * (1 + 0.05 * size / capacity), left, capacity)
        if not counts.any():
            break
        at = np.flatnonzero(counts)
        times = int((step * left[at] / counts[at]).min())  # rounded down
        if times < 1:
            times = 1
        take(counts, times)
    return packed + best_fit(left, packed, capacity)


def best_fit(left: np.ndarray, packed: list[tuple[int, dict[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Packs what rounding leaves over, longest first, each into the fullest sequence that has room, many at a time.

    Sequences with the same room go as one group (how often, counts); groups of `packed` with room are filled in place.
    """
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(times: int, counts: dict[int, int], room: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([times, counts])

    old = [(t, c) for t, c in packed]
    packed.clear()
    for times, counts in old:
        put(times, counts, capacity - sum(k * n for k, n in counts.items()))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(full, {length: each}, capacity - each * length)
                if rest:
                    put(1, {length: rest}, capacity - rest * length)
                break
            room = rooms[i]
            times, counts = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = min(n, room // length)
            into = min(times, n // each)
            if times > into:
                put(times - into, counts, room)
            put(into, counts | {length: counts.get(length, 0) + each}, room - each * length)
            n -= into * each
    return [(t, c) for g in groups.values() for t, c in g]


def places(packed: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length: key = length, first rank, pieces a sequence, first sequence, offset of its first piece."""
    rank: dict[int, int] = {}
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for times, counts in packed:
        offset = 0
        for length, each in counts.items():
            out.append((length, rank.get(length, 0), each, sequence, offset))
            rank[length] = rank.get(length, 0) + each * times
            offset += length * each
        sequence += times
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces with sequence_id and offset: every piece in one place, every sequence gapless and at most `capacity` long."""
    rows = saved(pieces(docs, tokenizer_path, id_col, text_col, capacity, end), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    table = places(configurations(histogram, capacity), capacity)
    held = rows.sparkSession.sparkContext.broadcast(table)  # grows with the number of configurations, not with the documents

    # Pieces of a length are dealt to as many buckets as they need; ranks count on from the buckets before.
    buckets = F.element_at(F.create_map(*(F.lit(x) for n in np.flatnonzero(histogram > RANKED).tolist() for x in (n, -(-int(histogram[n]) // RANKED)))), F.col("length").cast("int")) if (histogram > RANKED).any() else F.lit(1)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(buckets, F.lit(1))).cast("int")
    dealt = rows.withColumn("bucket", bucket)
    sums = dealt.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    sums = small(saved(sums.select("length", "bucket", before.alias("before")), "rank-buckets"))  # a row for each length, and one more for each RANKED pieces
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.join(sums, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inner) - 1).drop("bucket", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        scale = np.int64(1) << 44
        keys = t["length"] * scale + t["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * scale + rank, "right") - 1
            nth = rank - t["rank"][at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(t["sequence"][at] + nth // t["each"][at]), pa.array(t["offset"][at] + nth % t["each"][at] * length)], names=[*names, "sequence_id", "offset"])

    kind = dict(rows.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
