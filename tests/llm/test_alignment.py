"""Cross-tokenizer alignment against a loop over token spans."""

from __future__ import annotations

import dataclasses
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkcurate.llm import alignment

SCHEMA = "doc_id long, text string, row string, found int, tid string, copies int, `a.b` int"


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()

    def spans(parts):
        at, out = 0, []
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in parts)

    def both(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        (x, p), (y, q) = spans(left), spans(right)
        return (x, y) if p == q == b" " + text.encode() else None

    return both


def _brute(texts, both):
    """Sizes, links, groups of every text, then its sums over corpus counts."""
    found, counts = {}, Counter()
    for text in texts:
        if not text:
            continue
        if text not in found:
            got = both(text)
            if got is None:
                found[text] = None
                continue
            x, y = got
            links = [(i, j) for i, s, e in x for j, u, v in y if s < v and u < e] if len(x) < 900 else _sweep(x, y)
            ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
            groups, start = [], 0
            for end in ends:
                groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (x, y))) if len(x) < 900 else None
                start = end
            found[text] = (len(x), len(y), len(ends), links, ";".join(groups))
        if found[text]:
            counts.update(set(found[text][3]))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for text in texts:
        one = found.get(text)
        if not one:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = one
        out.append((n_a, n_b, n_groups, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), groups))
    return out


def _sweep(x, y):
    out, j = [], 0
    for i, s, e in x:
        while y[j][2] <= s:
            j += 1
        k = j
        while k < len(y) and y[k][1] < e:
            out.append((i, y[k][0]))
            k += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["over", "Übung", "naïve", "the", "don't", "x=1", "日本語", "emoji😀", "<|endoftext|>", "</s>", "  ", "\n", "12345", "ſt", "…", "\u0085", "á"]
    some = [" ".join(rnd.choices(words, k=n)) for n in (1, 2, 5, 20, 80, 200)]
    odd = [None, "", " ", "  two", "tab\tand\nline\n\n", "▁ bar", "\x00nul", "trail  ", "a" * 300, "  　", "é" * 40]
    return [*odd, *some, some[2], some[2], some[4], some[4], ""]


def _table(spark, texts):
    return spark.createDataFrame([(i // 2 if i != 3 else None, t, "r", 1, "t", 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(4)


def _got(docs):
    rows = alignment.with_measures(docs).collect()
    return [(r.row.text, r.found.n_a, r.found.n_b, r.found.n_groups, r.found.n_links, r.found.n_best, r.found.count_sum, r.found.groups_sha256) for r in rows]


@pytest.mark.parametrize("chunk,segment", [(alignment.CHUNK_BYTES, alignment.SEGMENT), (300, 20)])
def test_measures(spark, texts, tools, monkeypatch, chunk, segment):
    """One chunk and many; whole texts and texts cut at spaces."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    want = [(t, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for t, w in zip(texts, _brute(texts, tools))]
    assert sorted(_got(_table(spark, texts)), key=str) == sorted(want, key=str)


def test_segments_do_not_change_the_ids(tools):
    path = public_tokenizers.path
    files = alignment.Files.read(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    assert files.pattern
    rnd = random.Random(8)
    text = " ".join(rnd.choices(["Straße", "don't", "I'll", "of", "the", "42nd", "  ", "\n", "x", "ends.", "日本", "éa"], k=4000))
    x, y = tools(text)
    own = alignment.Tokenizers(dataclasses.replace(files, segment=50))
    parts = [own.align(p) for p in own.segments(text)]
    assert len(parts) > 50
    assert [i for p in parts for i in p.a.tolist()] == [i for i, _, _ in x]
    assert [i for p in parts for i in p.b.tolist()] == [i for i, _, _ in y]


def test_long_texts(spark, tools):
    """A text of many segments, one long word, one long blank."""
    texts = ["word and Wort " * 40_000, "q" * 200_000, " " * 200_000, "!?" * 100_000]
    got = {g[0]: g for g in _got(_table(spark, texts))}
    for text in texts:
        both = tools(text)
        assert got[text][1:3] == ((len(both[0]), len(both[1])) if both else (0, 0))
        assert not both or got[text][4] == len(_sweep(*both))


def test_pairs_and_groups(spark, texts, tools):
    path = public_tokenizers.path
    files = alignment.Files.read(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), None)
    docs = _table(spark, texts)
    groups = {r.text: r.groups for r in alignment.aligned(docs, files).collect()}
    brute = dict(zip(texts, _brute(texts, tools)))
    assert groups == {t: brute[t][6] or None for t in texts if t}
    made, _ = alignment.chunks(docs, files)
    got = {(r.a, r.b): r.docs for r in alignment.pairs(alignment.pair_counts(made)).collect()}
    counts = Counter()
    for t in texts:
        both = tools(t) if t else None
        counts.update(set(_sweep(*both)) if both else ())
    assert got == counts


def test_empty_tables(spark):
    assert _got(_table(spark, ["x"]).limit(0)) == []
    assert {g[1:] for g in _got(_table(spark, [None, "", "▁"]))} == {(0, 0, 0, 0, 0, 0, "")}
