"""Alignment of two tokenizers over a corpus: which tokens of one cover which of the other, and how usual each such pair is.

A text is encoded by a byte-level BPE file (A) and by a SentencePiece model (B); both give tokens of bytes. Places where tokens of
both end cut the bytes into groups, and a token of A is linked with each token of B whose bytes overlap its own. How often a pair of ids is
linked in the whole corpus is its count; the pair that a B id is linked in most often (pairs, if several are) is that id's best one.

Texts are encoded once, in chunks: at places where both tokenizers always begin a new token, before a space that follows something
else, say, texts are cut, and a chunk is encoded and aligned by itself, kept under a number, and used again wherever it occurs. A batch
of documents is then counted as numbers of chunks, and saved as one row a document and, for each pair of ids, one posting row: in which of
its documents the pair is linked and how often. Counts are the sums of these rows, pre-aggregated in the tasks that read them.

Then posting rows are cogrouped by B id with the counts: both kinds of rows are dealt to partitions by B id and sorted by Spark, which spills
what doesn't fit, counts in front. A task streams over them; of one B id it holds its counts, at most one for each A id, finds the
highest, and passes the postings behind them on as contributions to documents, added up by document as they come and sent as one row a
batch. A B id with many postings is dealt to several parts by batch, each of which gets its counts. Contributions are summed by document.

Defined cases: null and empty texts, and texts whose joined tokens differ from a space and the text in bytes, have no tokens, zeros
everywhere and '' as groups; special tokens' strings are plain text; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shizuku.llm.common import dropped, give_back, saved, small

#: Chunks that a worker keeps, links and documents of a batch, about.
KEPT, BATCH_LINKS, BATCH_DOCS = 400_000, 1_500_000, 4096
#: Postings of one B id in one part of it, about, and postings that a task adds up before it passes them on.
PART, HELD = 4_000_000, 2_000_000
#: Letters and marks that may be parted, if no piece of the model holds the one before the other.
_LETTER, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?\n"
#: Bits of a document's or chunk's number in a sort key.
_BITS = 20


class Aligner:
    """Aligns texts chunk by chunk. Chunks have numbers; of each the counts, the groups as text and the codes of linked pairs are kept."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path_a)
        tokenizer.encode_special_tokens = True
        self.a, self.piece = lambda text: tokenizer.encode(text, add_special_tokens=False).ids, None
        self.b = SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        # The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for themselves, the others count up from 256.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        self.bytes_a = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
        self.shortcut(file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = np.zeros(max(self.bytes_a, default=0) + 1, np.int64), np.array(list(map(len, self.bytes_b)), np.int64)
        for i, b in self.bytes_a.items():
            self.lengths_a[i] = len(b)
        self.shift = max(1, len(pieces) - 1).bit_length()
        if max(self.bytes_a, default=0).bit_length() + self.shift + _BITS > 63:
            raise ValueError("the vocabularies are too large for codes of pairs")
        # Cuts hold only where no piece goes on over them.
        held = "\0".join(pieces)
        self.words_hold = not re.search("[^▁\0]▁", held)
        marks = "".join(m for m in _MARKS if not re.search(f"[{_LETTER}]{re.escape(m)}", held))
        rules = [r"(?<=[\w!-~])(?= +[^ ])"] if self.words_hold else []
        rules += [f"(?<=[{_LETTER}])(?=[{marks}])"] if marks else []
        self.lines = "\n" not in held
        rules += [r"(?<=[\w!-~])(?=\n)", r"(?<=[\w!-~]\n)(?=\S)"] if self.lines else []
        self.cut = re.compile("|".join(rules)) if rules and self.lines else None
        self.clear()

    def shortcut(self, file: dict) -> None:
        """Where the file is byte-level BPE with the usual pattern and ids in the order of its merges, a quicker library gives the same ids."""
        model, pre = file["model"], file["pre_tokenizer"] or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not file["normalizer"] and not file["post_processor"] and not model.get("ignore_merges")
        special = {x["content"] for x in file["added_tokens"]}
        usual = {t: i for t, i in model["vocab"].items() if t not in special}
        if not plain or any(usual.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(usual) != 256 + len(merges):
            return
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in usual.values()}, special_tokens={})
        self.a, self.piece = own._core_bpe.encode_ordinary, own._core_bpe.encode_single_piece

    def clear(self) -> None:
        """Forgets all chunks."""
        self.words: dict[str, int | tuple[int, ...]] = {}
        self.chunks: dict[str, int] = {}
        self.groups: list[str] = []
        self.fits, self.waiting = bytearray(), []
        self.sizes, self.links = array("q"), array("q")  # of each n_a, n_b, n_groups, n_links

    def number(self, chunk: str) -> int:
        """The number of a chunk; new ones wait for `settle`."""
        found = self.chunks.get(chunk)
        if found is None:
            found = self.chunks[chunk] = len(self.chunks)
            self.waiting.append(chunk)
        return found

    def settle(self) -> None:
        """Aligns all chunks that wait, as if they were one text: chunks where bytes differ count as empty."""
        chunks, self.waiting = self.waiting, []
        if not chunks:
            return
        ids_a = [self.piece(c.encode()) if self.piece and c.isascii() and c[0] == " " and c[1:].isalpha() else self.a(c) for c in chunks]
        # The model puts a space in front; where the chunk has none, a line end stands behind that, a token of its own.
        ids_b = self.b.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        ids_b = [x if c[0] == " " else x[2:] for c, x in zip(chunks, ids_b, strict=True)]
        join, of_a, of_b = b"".join, self.bytes_a.get, self.bytes_b.__getitem__
        whole = bytes(join(map(of_b, b)) == join([of_a(i, b"") for i in a]) == c.encode() for c, a, b in zip(chunks, ids_a, ids_b, strict=True))
        if 0 in whole:
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, whole, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.lengths_a[flat_a]), np.cumsum(self.lengths_b[flat_b])
        ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]  # of chunks; those that don't fit end where the one before does
        # Between two neighbouring ends of any tokens lies one token of each side: a link.
        marks, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = flat_a[np.searchsorted(ends_a, marks)] << self.shift | flat_b[np.searchsorted(ends_b, marks)]
        at = np.searchsorted(ends, common)
        n_groups, n_links = np.bincount(at, minlength=len(chunks)), np.bincount(np.searchsorted(ends, marks), minlength=len(chunks))
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        stop_a, stop_b = (np.searchsorted(x, common, "right").tolist() for x in (ends_a, ends_b))
        groups = [f"{','.join(text_a[a:i])}|{','.join(text_b[b:j])}" for a, i, b, j in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b, strict=False)]
        first = 0
        for n in n_groups.tolist():
            self.groups.append(groups[first] if n == 1 else ";".join(groups[first : first + n]))
            first += n
        self.fits += whole
        self.sizes.frombytes(np.stack([n_a, n_b, n_groups, n_links], 1).astype(np.int64).tobytes())
        self.links.frombytes(links.tobytes())

    def numbers(self, text: str) -> list[int]:
        """The chunks of a space and the text."""
        if self.cut is None:
            return [self.number(" " + text)]
        out, words = [], text.split(" ") if self.words_hold else []
        known, split, number = self.words, self.cut.split, self.number
        last = len(words) - 1
        for k, w in enumerate(words):
            found = known.get(w)
            if found is None:
                end = w[-1:]
                part = "!" <= end <= "~" or end.isalnum()  # something that a space behind it can be cut from
                if not part and (k < last or not end):
                    out = []  # what lies between words isn't one space behind something else
                    break
                own = [number(c) for c in split(" " + w)]
                found = own[0] if len(own) == 1 else tuple(own)
                if part and "\n" not in w:
                    known[w] = found
            if type(found) is int:
                out.append(found)
            else:
                out += found
        return out or [number(c) for c in split(" " + text)]

    def full(self) -> bool:
        return len(self.chunks) > KEPT or len(self.links) > 8 * KEPT or len(self.words) > KEPT

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts by chunk, where the links of each begin, and the links."""
        sizes = np.frombuffer(self.sizes, np.int64).copy().reshape(-1, 4)
        return sizes, np.concatenate([[0], np.cumsum(sizes[:, 3])]), np.frombuffer(self.links, np.int64).copy()


#: Aligners of this worker process by their paths: loading takes longer than many a task.
_LOADED: dict[tuple[str, str], Aligner] = {}


def _loaded(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED.clear()
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _weights(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight, first)


_SAVED = "kind string, batch long, doc int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, n long, docs array<int>, times array<int>"


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of the kinds `doc`, one a document with its id as `key`, and `post`, one for each batch and pair of ids."""
    key_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _loaded(path_a, path_b)
        part, batch_no, keys, chunks, held = TaskContext.get().partitionId(), 0, [], [], 0
        low = (1 << _BITS) - 1

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            batch, n = part << 32 | batch_no, len(keys)
            aligner.settle()
            fits, groups = aligner.fits.__getitem__, aligner.groups.__getitem__
            chunks[:] = [own if all(map(fits, own)) else [] for own in chunks]
            shas = [hashlib.sha256(";".join(map(groups, own)).encode()).hexdigest() if own else "" for own in chunks]
            sizes, begin, links = aligner.tables()
            number = np.array([c for cs in chunks for c in cs], np.int64)
            doc = np.repeat(np.arange(n), [len(cs) for cs in chunks])
            sums = np.stack([np.bincount(doc, sizes[number, i], n).astype(np.int64) for i in range(4)], 1) if len(number) else np.zeros((n, 4), np.int64)
            none = lambda t, m: pa.nulls(m, t)
            lists = pa.list_(pa.int32())
            names = ["kind", "batch", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n", "docs", "times", "key"]
            head = [pa.array(["doc"] * n), pa.array([batch] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array(sums[:, i]) for i in range(4)), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([*head, *(none(t, n) for t in (pa.int32(), pa.int32(), pa.int64(), lists, lists)), pa.array(keys, kind)], names=names)
            # Chunks by document first, then the links of each different one.
            key, times = _weights(doc << 32 | number, np.ones(len(number), np.int64))
            doc, number = key >> 32, key & 0xFFFFFFFF
            m = sizes[number, 3]
            at = np.repeat(begin[number] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if len(m) else np.zeros(0, np.int64)
            key, times = _weights(links[at] << _BITS | np.repeat(doc, m), np.repeat(times, m))
            pair, doc = key >> _BITS, (key & low).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            ends, pair = np.append(first, len(pair)).astype(np.int32), pair[first]
            total = np.add.reduceat(times, first) if len(first) else times
            for lo in range(0, len(pair), 20_000):
                hi = min(lo + 20_000, len(pair))
                m, cut = hi - lo, slice(ends[lo], ends[hi])
                offsets = pa.array(ends[lo : hi + 1] - ends[lo], pa.int32())
                empty = [none(t, m) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(x[cut].astype(np.int32), pa.int32())) for x in (doc, times)]
                ids = [pa.array((pair[lo:hi] >> aligner.shift).astype(np.int32)), pa.array((pair[lo:hi] & (1 << aligner.shift) - 1).astype(np.int32)), pa.array(total[lo:hi].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(["post"] * m), pa.array([batch] * m, pa.int64()), *empty, *ids, *arrays, none(kind, m)], names=names)
            if aligner.full():
                aligner.clear()

        for table in batches:
            kind = table.schema.field(0).type
            for key, text in zip(table.column(0).to_pylist(), table.column(1), strict=True):
                text = text.as_py()
                keys.append(key)
                chunks.append(aligner.numbers(text) if text else [])
                held += len(chunks[-1])
                if held >= BATCH_LINKS or len(keys) >= BATCH_DOCS or aligner.full():
                    yield from flush(kind)
                    batch_no, keys, chunks, held = batch_no + 1, [], [], 0
        if keys:
            yield from flush(kind)  # chunks stay for the worker's next task
        give_back()

    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"{_SAVED}, key {key_kind}")


def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, docs, best, sums from rows sorted by b and part: counts (a, n) come first, then posting rows."""
    counts: dict[int, int] = {}
    now, best, held = None, 0, 0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        batch, doc, bests, sums = (np.concatenate([p[i] for p in parts]) for i in range(4))
        parts.clear()
        order = np.lexsort((doc, batch))
        batch, doc, bests, sums = batch[order], doc[order], bests[order], sums[order]
        first = np.flatnonzero(np.concatenate([[True], (batch[1:] != batch[:-1]) | (doc[1:] != doc[:-1])]))
        batch, doc, bests, sums = batch[first], doc[first], np.add.reduceat(bests, first), np.add.reduceat(sums, first)
        ends = np.append(np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])), len(batch)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (doc.astype(np.int32), bests, sums)]
        yield pa.RecordBatch.from_arrays([pa.array(batch[ends[:-1]]), *lists], names=["batch", "docs", "best", "sums"])

    for table in batches:
        b, part, a, n, batch = (table.column(x).to_numpy(zero_copy_only=False) for x in ("b", "part", "a", "n", "batch"))
        docs, times = table.column("docs"), table.column("times")
        posts = docs.is_valid().to_numpy(zero_copy_only=False)
        own, top = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
        for i, (key, id_a, count, post) in enumerate(zip(zip(b.tolist(), part.tolist(), strict=True), a.tolist(), n.tolist(), posts.tolist(), strict=True)):
            if now != key:
                now, best = key, 0
                counts.clear()
            if post:
                own[i] = count = counts[id_a]
                top[i] = count == best
            else:
                counts[id_a] = count
                best = max(best, count)
        size = pc.list_value_length(docs).fill_null(0).to_numpy(zero_copy_only=False)
        doc, each = docs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        if len(doc):
            parts.append((np.repeat(np.where(posts, batch, 0).astype(np.int64), size), doc, np.where(np.repeat(top, size), each, 0), each * np.repeat(own, size)))
            held += len(doc)
        if held >= HELD:
            yield from flush()
            held = 0
    yield from flush()
    give_back()


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, doc, n_best, count_sum from contributions sorted by batch: one batch's documents are held at a time."""
    now, best, sums = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(sums)  # a document with a link has a count
        if now is not None and len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int64)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(sums[at])], names=["batch", "doc", "n_best", "count_sum"])

    for table in batches:
        for batch, doc, b, s in zip(table.column("batch").to_pylist(), table.column("docs"), table.column("best"), table.column("sums"), strict=True):
            if batch != now:
                yield from done()
                now, best, sums = batch, np.zeros(BATCH_DOCS, np.int64), np.zeros(BATCH_DOCS, np.int64)
            at = doc.values.to_numpy()
            best[at] += b.values.to_numpy()
            sums[at] += s.values.to_numpy()
    yield from done()


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (a, b, n, best)."""
    rows = saved(encoded(docs, path_a, path_b, id_col, text_col), "alignments")
    posts = rows.filter("kind = 'post'").select("batch", "a", "b", "n", "docs", "times")
    counts = saved(posts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.size("docs").cast("long")).alias("postings")), "pair-counts")
    # A B id of many postings is dealt to parts by batch; its counts go to each of them.
    wide = counts.groupBy("b").agg(F.sum("postings").alias("postings"), F.max("n").alias("most"))
    wide = saved(wide.select("b", "most", F.ceil(F.col("postings") / PART).cast("int").alias("parts")), "ids")
    parts = small(wide.filter("parts > 1").select("b", "parts"))
    no = F.lit(None)
    dealt_counts = counts.join(parts, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt_counts = dealt_counts.select("b", "part", "a", "n", no.cast("long").alias("batch"), no.cast("array<int>").alias("docs"), no.cast("array<int>").alias("times"))
    dealt_posts = posts.join(parts, "b", "left").withColumn("part", F.pmod(F.xxhash64("batch"), F.coalesce("parts", F.lit(1))).cast("int")).select("b", "part", "a", "n", "batch", "docs", "times")
    both = dealt_counts.unionByName(dealt_posts).repartition("b", "part").sortWithinPartitions("b", "part", F.col("batch").asc_nulls_first(), "a")
    given = both.mapInArrow(contributions, "batch long, docs array<int>, best array<long>, sums array<long>")
    sums = given.repartition("batch").sortWithinPartitions("batch").mapInArrow(summed, "batch long, doc int, n_best long, count_sum long")
    own = rows.filter("kind = 'doc'").select("batch", "doc", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    whole = own.join(sums, ["batch", "doc"], "left").fillna(0, ["n_best", "count_sum"])
    documents = saved(whole.select("key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "aligned")
    dropped(rows)
    return documents, counts.join(small(wide), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return align(docs, path_a, path_b)[0].withColumnRenamed("key", "doc_id")
