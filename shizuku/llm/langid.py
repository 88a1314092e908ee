"""Language of mixed texts: scripts narrow the candidates, per-word scores and a Viterbi pass label spans.

A word's letters decide its script, and only languages seen in that script are candidates for it. Each candidate scores
the word by the log probability of its character 1- to 4-grams. The best path through the words of a text, where each
change of language costs a penalty, labels every word; runs of one label are the spans of the text.

The model is counted on at most `most` labelled rows (the rows with the smallest hash of their id).

Defined cases: null texts and texts without a letter give `und`, score 0, no spans; a text whose letters are in no
learned script gives the most frequent language, score 0; repeated rows give repeated results.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shizuku.llm.common import give_back

#: Labelled rows that a model is counted on at most, buckets of hashed character n-grams, their longest length.
MOST, BUCKETS, LONGEST = 4000, 1 << 15, 4
#: What a change of language costs, in nats; words whose scores a worker keeps.
SWITCH, KEPT = 12.0, 100_000
# Ranges of code points by script (Unicode blocks that hold the letters of living languages).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
#: Letters outside of these ranges belong to the block of this many code points that they stand in.
BLOCK = 128
NAMES = sorted({x[0] for x in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the number of a letter's script, -1 for all else, and whether it is a letter."""
    letter = np.zeros(0x110000, bool)
    letter[:0x30000] = [unicodedata.category(chr(i))[0] == "L" for i in range(0x30000)]
    letter[0x30000:0x33480] = True
    script = len(NAMES) + np.arange(0x110000, dtype=np.int32) // BLOCK
    for name, lo, hi in SCRIPTS:
        script[lo : hi + 1] = NAMES.index(name)
    return np.where(letter, script, -1), letter


@dataclass
class Model:
    """langs by code point; log probabilities by (n-gram bucket, language); for each script the languages that use it."""

    langs: list[str]
    table: np.ndarray
    uses: dict[int, np.ndarray]
    common: int
    switch: float = SWITCH
    cache: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None
    filled: int = 0
    chars: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "scores": None, "letters": None, "filled": 0, "chars": None}


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ' word' + ' ' after one another; for each n the hashed n-gram that ends at each place (-1: none)."""
    joined = "".join(f" {w} " for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.arange(len(chars)) - np.repeat(starts[:-1], lengths)
    out = np.full((LONGEST, len(chars)), -1, np.int64)
    mixed = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[n - 1 :] = chars[: len(chars) - n + 1]
        mixed = mixed * np.uint64(1_000_003) + shifted + np.uint64(n)
        full = mixed ^ (mixed >> np.uint64(17))
        full = full * np.uint64(0x9E3779B97F4A7C15)
        ok = inside >= n - 1 if n > 1 else (chars != 32)
        out[n - 1][ok] = (full[ok] >> np.uint64(49)).astype(np.int64) % BUCKETS
    return chars, starts, out


def split_words(text: str) -> list[str]:
    return text.lower().split()


def train(labelled: DataFrame, text_col: str, label_col: str, id_col: str, most: int = MOST, switch: float = SWITCH) -> Model:
    """A model from at most `most` different rows with text and label; rows that are equal in id, text and label count once."""
    usable = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    named = usable.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    # Only ids, hashes and labels are sorted; the texts of the chosen rows, at most `most`, are counted where they lie.
    own = ["__id", "__h", "lang"]
    chosen = named.select(*own).distinct().orderBy(F.xxhash64("__id"), *own).limit(most)
    rows = named.join(F.broadcast(chosen), own, "left_semi").dropDuplicates(own)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        script, _ = _tables()
        held: dict[str, list] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                got = held.setdefault(lang, [np.zeros(BUCKETS), Counter(), 0])
                for text in group["text"]:
                    words = split_words(text)
                    if not words:
                        continue
                    chars, _, found = grams(words)
                    for f in found:
                        got[0] += np.bincount(f[f >= 0], minlength=BUCKETS)
                    got[1].update(dict(zip(*(x.tolist() for x in np.unique(script[np.minimum(chars, 0x10FFFF)], return_counts=True)), strict=True)))
                    got[2] += 1
        for lang, (c, s, n) in held.items():
            at = np.flatnonzero(c)
            scripts = [k for k in s if k >= 0]
            yield pd.DataFrame({"lang": lang, "kind": ["gram"] * len(at) + ["script"] * len(scripts) + ["text"], "key": [*at.tolist(), *scripts, 0], "n": [*c[at].tolist(), *(s[k] for k in scripts), n]})

    # Added up in the cluster: a row for each language and n-gram bucket or script comes to the driver.
    counted = rows.select("text", "lang").mapInPandas(count, "lang string, kind string, key long, n double").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), {}, -1, switch)
    at = counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    kind, key, n = counted["kind"].to_numpy(), counted["key"].to_numpy(), counted["n"].to_numpy()
    counts, texts = np.full((BUCKETS, len(langs)), 0.5), np.zeros(len(langs))
    counts[key[kind == "gram"], at[kind == "gram"]] += n[kind == "gram"]
    texts[at[kind == "text"]] = n[kind == "text"]
    table = np.log(counts / counts.sum(0))
    table -= table.mean(1, keepdims=True)
    letters = np.bincount(at[kind == "script"], weights=n[kind == "script"], minlength=len(langs))
    uses: dict[int, np.ndarray] = {}
    for i, script, letters_in in zip(at[kind == "script"], key[kind == "script"], n[kind == "script"], strict=True):
        if letters_in > 0.01 * max(letters[i], 1):
            uses.setdefault(int(script), np.zeros(len(langs), bool))[i] = True
    return Model(langs, table.astype(np.float32), uses, int(np.argmax(texts)), switch)


def word_scores(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (word, language) and letters in each word; words without a learned script score 0 for all."""
    if model.chars is None:
        model.chars = _tables()
    script, letter = model.chars
    chars, starts, found = grams(words)
    k = len(model.langs)
    sums = np.zeros((len(words), k), np.float32)
    padded = np.vstack([model.table, np.zeros((1, k), np.float32)])
    for f in found:
        sums += np.add.reduceat(padded[f], starts[:-1])
    chars = np.minimum(chars, 0x10FFFF)
    letters = np.add.reduceat(letter[chars].astype(np.int64), starts[:-1])
    s = script[chars]
    allowed = np.zeros((len(words), k), bool)
    for i in np.unique(s).tolist():
        if i in model.uses:
            has = np.logical_or.reduceat(s == i, starts[:-1])
            allowed |= has[:, None] & model.uses[i][None, :]
    # A word in scripts that no language uses is left open; in a known script, other languages are out.
    known = allowed.any(1)
    sums[~known] = 0
    sums = np.where(known[:, None] & ~allowed, np.float32(-50), sums)
    return sums, np.where(known, letters, -letters)


def lookup(model: Model, words: list[str]) -> np.ndarray:
    """Rows of model.scores for words; unknown words are scored together and kept."""
    get = model.cache.get
    rows = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    missing = np.flatnonzero(rows < 0)
    if len(missing):
        if len(model.cache) > KEPT:
            model.cache.clear()
            model.filled = 0
            return lookup(model, words)
        new = list(dict.fromkeys(words[i] for i in missing))
        at = model.filled
        if model.scores is None or at + len(new) > len(model.scores):
            size = 2 * (at + len(new))
            grown, more = np.zeros((size, len(model.langs)), np.float32), np.zeros(size, np.int32)
            if at:
                grown[:at], more[:at] = model.scores[:at], model.letters[:at]
            model.scores, model.letters = grown, more
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            model.scores[at + i : at + i + len(part)], model.letters[at + i : at + i + len(part)] = word_scores(model, part)
        model.cache.update(zip(new, range(at, at + len(new)), strict=True))
        model.filled = at + len(new)
        rows[missing] = [model.cache[words[i]] for i in missing]
    return rows


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every row of scores (word, language); texts are the stretches between starts. All texts advance together, longest first."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, n = starts[:-1][order], lengths[order]
    k = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores) or k < 2:
        return labels
    stay = np.zeros((len(scores), k), bool)
    source = np.zeros(len(scores), np.int16)
    alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
    value = scores[first[: alive[0]]].astype(np.float64)
    final = np.zeros(len(first), np.int16)
    for t in range(1, n[0]):
        live = alive[t]
        if live < len(value):
            final[live : len(value)] = value[live:].argmax(1)
            value = value[:live]
        at = first[:live] + t
        best = value.argmax(1)
        change = value[np.arange(live), best][:, None] - switch
        stay[at] = value >= change
        source[at] = best
        value = np.maximum(value, change) + scores[at]
    final[: len(value)] = value.argmax(1)
    for t in range(n[0] - 1, -1, -1):
        live = alive[t]
        at = first[:live] + t
        labels[at] = final[:live]
        if t:
            kept = stay[at, final[:live]]
            final[:live] = np.where(kept, final[:live], source[at])
    return labels


#: Words times languages that go through one Viterbi pass together, at most, besides those of one text.
TOGETHER = 4_000_000


def label(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans as (language, first word, words)) of each text."""
    at = 0
    while at < len(texts):
        words: list[str] = []
        starts = [0]
        while at < len(texts) and (not words or len(words) * len(model.langs) < TOGETHER):
            words += split_words(texts[at]) if texts[at] else []
            starts.append(len(words))
            at += 1
        bounds = np.array(starts)
        if not words or not model.langs:
            for _ in range(len(starts) - 1):
                yield "und", 0.0, []
            continue
        rows = lookup(model, words)
        scores, letters = model.scores[rows], model.letters[rows]
        labels = viterbi(scores, bounds, model.switch)
        known = np.maximum(letters, 0)
        for i in range(len(bounds) - 1):
            lo, hi = bounds[i], bounds[i + 1]
            total = int(np.abs(letters[lo:hi]).sum())
            if not total:
                yield "und", 0.0, []
                continue
            share = np.bincount(labels[lo:hi], weights=known[lo:hi], minlength=len(model.langs))
            if not share.any():
                yield model.langs[model.common], 0.0, []
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels[lo:hi])) + 1, [hi - lo]])
            spans = [(model.langs[labels[lo + a]], int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            top = int(share.argmax())
            yield model.langs[top], float(share[top] / total), spans


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all but the text by default) with lang_pred, lang_score and lang_spans, an array of (lang, first, words)."""
    own = (text_col, "lang_pred", "lang_score", "lang_spans")  # columns of these names give way
    keep = [c for c in docs.columns if c not in own] if keep is None else keep
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # its size is fixed: n-gram buckets times languages
    kept = docs.select(*keep, F.col(text_col).alias("__sz_text"))
    kind = kept.drop("__sz_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(label(held.value, batch.column(batch.num_columns - 1).to_pylist()))
            spans = pa.array([[{"lang": a, "first": b, "words": c} for a, b, c in x[2]] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], names=[*batch.schema.names[:-1], "lang_pred", "lang_score", "lang_spans"])
            del found, spans
        give_back()

    from pyspark.sql import types as T

    out = T.StructType([*kind.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])))])
    return kept.mapInArrow(run, out)
