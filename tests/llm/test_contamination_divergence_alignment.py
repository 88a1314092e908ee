"""Decontamination, source divergence and tokenizer alignment against brute force and odd rows."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from shizuku.llm import alignment, decontaminate, divergence
from shizuku.llm import queries as registered

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXT = "the quick brown fox jumps over the lazy dog near the old river bank today"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def window_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, width=10):
    grams = defaultdict(set)
    for item, text in items:
        ws = window_words(text)
        for i in range(max(1, len(ws) - width + 1)) if ws else []:
            grams[tuple(ws[i : i + width])].add(item)
    out = []
    for key, text in docs:
        ws, hit, found = window_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(ws) - n + 1):
                if own := grams.get(tuple(ws[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((key, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_odd_rows(spark):
    words = TEXT.split()
    items = [(1, TEXT), (12, TEXT.upper() + "!"), (2, "Über ÉTÉ only"), (3, None), (4, ""), (5, "?!"), (None, "nobody knows me at all"), (6, "solo"), (6, "solo")]
    docs = [
        (1, "Start here: " + TEXT.replace(" ", ", ") + " end. " + TEXT), (1, "Start here: " + TEXT.replace(" ", ", ") + " end. " + TEXT), (2, " ".join(words[:9])), (3, "x " + " ".join(words[:10])), (4, None), (5, ""), (6, "...---"),
        (None, "a SOLO b solo"), (7, "über été only"), (8, "Über ÉTÉ only"), (9, "nobody knows me at all"), (10, " ".join(words[3:] * 40)), (11, "\x1c".join(words)), (12, "naïve " * 30000), (13, "\U0001d54f solo　x"),
    ]
    d = spark.createDataFrame([(*x, "own", 5) for x in docs], "doc_id long, text string, spans string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.digest(decontaminate.scan(d, b)).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(contamination(docs, items))
    none = decontaminate.digest(decontaminate.scan(d, b.filter("false"))).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in none)
    assert decontaminate.scan(d.filter("false"), b).count() == 0


def test_removal(spark):
    items = spark.createDataFrame([(1, TEXT), (2, "alpha beta")], "item_id long, text string")
    docs = [(1, f"Before. {TEXT.title()}! After, alpha  Beta; end."), (2, "Clean text stays, every\n\tbyte of it."), (3, None), (4, "alpha, beta")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in decontaminate.decontaminated(d, items).collect()}
    assert kept == {2, 3}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(d, items, remove="spans").collect()}
    assert clean == {1: "Before. ! After, ; end.", 2: docs[1][1], 3: None, 4: ""}
    two = {r["doc_id"] for r in decontaminate.decontaminated(d, items, least_items=2).collect()}
    assert two == {2, 3, 4}
    with pytest.raises(ValueError, match="remove"):
        decontaminate.decontaminated(d, items, remove="words")


def test_contamination_of_random_texts(spark):
    draw = random.Random(5)
    vocabulary = ["aa", "Bb", "cç", "d1", "É"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    docs = [(i, text(draw.randrange(40))) for i in range(120)]
    items = [(i % 17, text(draw.randrange(7))) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.digest(decontaminate.scan(d, b, width=4)).collect())
    assert got == sorted(contamination(docs, items, width=4))


def divergences(rows, min_docs=3, listed=200):
    """Every group with every kept term, in Python's whole numbers."""
    groups, freq, lang_n = defaultdict(Counter), Counter(), Counter()
    for lang, source, text in rows:
        ts = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(ts)
        freq.update((lang or "", t) for t in set(ts))
        lang_n.update((lang or "", t) for t in ts)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (own, t), n in freq.items() if own == lang and n >= min_docs]
        of = {s: groups[lang, s] for own, s in groups if own == lang}
        share = lambda counts, kept=kept: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in of.items()}, share(Counter({t: lang_n[lang, t] for t in kept}))
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            pair = [(o, sum(f(p[t], r[t]) for t in kept)) for o, r in shares.items() if o != s]
            term = [(t, f(p[t], q[t])) for t in kept if of[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, listed)):
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)][:most]
    return sorted(out)


def test_divergence(spark):
    draw = random.Random(3)
    vocabulary = [*"abcdefgh", "Été", "été", "\U0001d54f", "日本", "z" * 300]
    rows = [(draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s1", "s1", "s2", "s3", None]), " ".join(draw.choices(vocabulary, k=draw.randrange(12)))) for _ in range(300)]
    rows += [("fr", "only", "un un deux"), ("it", "x", "a b"), ("it", "y", None), ("it", "z", ""), ("nl", "x", "een een"), ("nl", "x", "een een"), ("nl", "x", "een"), ("nl", "y", "12 . 34"), ("nl", "q", "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, item string, p int")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == divergences(rows)
    few = sorted(tuple(r) for r in divergence.audit(docs, min_docs=1, listed=2).collect())
    assert few == divergences(rows, 1, 2)
    assert divergence.audit(docs.filter("false")).count() == 0


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (7, 10**13, 10**7), (10**13 - 1, 10**13, 3), (123_456_789_012, 999_999_999_999, 12_345), (0, 2 * 10**14, 5)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]


def tokens_of(text):
    """Ids and bytes by both tokenizers of a whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(tokens_of, "both"):
        a = Tokenizer.from_file(public_tokenizers.path(A))
        a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        with open(public_tokenizers.path(A)) as f:
            vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
        tokens_of.both = a, SentencePieceProcessor(model_file=public_tokenizers.path(B)), byte, vocab
    a, b, byte, vocab = tokens_of.both
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte[c] for c in vocab[i]) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    return ids_a, raw_a, ids_b, raw_b


def alignments(docs):
    found, counts = [], Counter()
    for key, text in docs:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            ids_a, raw_a, ids_b, raw_b = tokens_of(text)
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends_a, ends_b = list(itertools.accumulate(map(len, raw_a))), list(itertools.accumulate(map(len, raw_b)))
                n_a, n_b, j, low = len(ids_a), len(ids_b), 0, 0
                for i, end in enumerate(ends_a):
                    while j < n_b and ends_b[j] - len(raw_b[j]) < end:
                        links.append((ids_a[i], ids_b[j]))
                        if ends_b[j] > end:
                            break
                        j += 1
                for end in sorted({*ends_a} & {*ends_b}):
                    groups.append(",".join(str(x) for x, e in zip(ids_a, ends_a, strict=True) if low < e <= end) + "|" + ",".join(str(x) for x, e in zip(ids_b, ends_b, strict=True) if low < e <= end))
                    low = end
        counts.update(links)
        found.append((key, n_a, n_b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((key, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest) for key, n_a, n_b, n_groups, links, digest in found), key=str), counts, best


ODD = ["Hello world, it's 12  spaces   here.\n\n New line\r\nand\ttab ", "  leading", "trailing  ", "<|endoftext|> </s> <s> <unk> <0x41>", "▁ literal", "日本語のテキスト", "été naïve \U0001f600\U0001f1eb\U0001f1f7", "a b c ​ d", " \n \n ", "x" * 500, "();\r if {\r }", "\x00 nul \x1c \x85 e"]


def test_alignment_by_brute_force(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, ""), (92, ODD[0]), (92, ODD[0]), (None, "the end")]
    docs += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    d = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, n_a int, kind string")
    want, counts, best = alignments(docs)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    paths = public_tokenizers.path(A), public_tokenizers.path(B)
    got = alignment.digest(d, *paths).select(*cols).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    monkeypatch.setattr(alignment, "PART", 20)  # B ids dealt to many parts
    split, pairs = alignment.align(d, *paths)
    assert sorted((tuple(r) for r in split.select("key", *cols[1:]).collect()), key=str) == want
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {k: (n, n == best[k[1]]) for k, n in counts.items()}
    assert alignment.digest(d.filter("false"), *paths).count() == 0


def test_chunks_give_the_tokens_of_whole_texts():
    aligner = alignment.Aligner(public_tokenizers.path(A), public_tokenizers.path(B))
    assert aligner.cut is not None
    draw = random.Random(1)
    pieces = ["a", "the", "s'", "'s", " ", " ", "  ", "\n", "\n", "\t", "\r", ".", ",", "!?", "12", "²", "é", "×", "\u00a0", "日", "\U0001f600", "▁", "_", "\u200b", "\x1f", "\x85", "-", "<s>", "Word"]
    for k in range(6000):
        text = "".join(draw.choices(pieces, k=draw.randrange(1, 14)))
        ids_a, raw_a, ids_b, raw_b = tokens_of(text)
        fits = b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()
        own = aligner.numbers(text)
        aligner.settle()
        assert all(aligner.fits[i] for i in own) == fits, repr(text)
        if fits:
            sizes = [aligner.sizes[4 * i : 4 * i + 4] for i in own]
            assert (sum(x[0] for x in sizes), sum(x[1] for x in sizes)) == (len(ids_a), len(ids_b)), repr(text)
            groups = ";".join(aligner.groups[i] for i in own).split(";")
            assert [int(x) for g in groups for x in g.split("|")[0].split(",")] == ids_a and [int(x) for g in groups for x in g.split("|")[1].split(",")] == ids_b, repr(text)
        if k % 1000 == 0:
            aligner.clear()


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_source_divergence", "op13_tokenizer_alignment"])
def test_registered(spark, sf_dir, name):
    rows = registered.queries()[name](spark, sf_dir)
    assert rows.count() > 0
