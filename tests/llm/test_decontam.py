"""Decontamination by suffix arrays against a scan of every window."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sparkcurate.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(text, items, window):
    """Words, hit places, items, longest match that has a window."""
    words, hit, named, longest = _words(text), set(), set(), 0
    for item, body in items:
        own = _words(body)
        n = min(len(own), window)
        for j in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[j : j + n]:
                    hit.update(range(i, i + n))
                    named.add("" if item is None else str(item))
                    m = n
                    while i + m < len(words) and j + m < len(own) and words[i + m] == own[j + m]:
                        m += 1
                    longest = max(longest, m)
    return len(words), hit, sorted(named), longest


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(5)

    def some(n):
        return " ".join(rnd.choice(["red", "blue", "Été", "of", "the", "x9"]) + str(rnd.randint(0, 30)) for _ in range(n))

    return [(1, some(40)), (2, some(12)), (2, some(12)), (3, "one two  three"), (4, "Solo"), (None, some(15)), (5, None), (6, " .,; "), (7, some(10)), (8, "again " * 14), (9, some(300))]


@pytest.fixture(scope="module")
def texts(items):
    rnd = random.Random(6)
    noise = [" ".join(rnd.choice(["red", "blue", "of", "the", "one", "two"]) + str(rnd.randint(0, 30)) for _ in range(n)) for n in (0, 1, 9, 60, 500)]
    whole = [f"{noise[3]} {b} {noise[2]}" for _, b in items if b]
    part = [" ".join(b.split()[3:16]).upper().replace(" ", "-") for _, b in items if b and len(b.split()) > 20]
    twice = [f"{items[0][1]} {noise[2]} {items[0][1]}", "again " * 40, "ONE,two\nthree solo ones", "solo"]
    return [None, "", "\x00\x7f", *noise, *whole, *part, *twice, f"{noise[4]} " * 8 + items[9][1] + " " + items[10][1]]


SCHEMA = "doc_id long, text string, row string, found int, item_id string, n_hit int, `a.b` int"


def _table(spark, texts, n=3):
    return spark.createDataFrame([(i // 2 if i != 4 else None, t, "r", 1, "i", 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(n)


def _check(got, texts, items, window=decontam.WINDOW):
    got = sorted(got, key=lambda r: (r.row.text is not None, r.row.text))
    want = sorted(texts, key=lambda t: (t is not None, t))
    assert [r.row.text for r in got] == want
    for r in got:
        n, hit, named, longest = _brute(r.row.text, items, window)
        assert (r.found.n_words, r.found.n_hit, r.found["items"]) == (n, len(hit), named)
        assert {i for s in r.found.spans for i in range(s.start, s.end)} == hit
        assert all(a.end < b.start for a, b in zip(r.found.spans, r.found.spans[1:]))
        assert (r.found.longest.length if r.found.longest else 0) == longest


@pytest.mark.parametrize("words,piece,shard", [(decontam.BLOCK_WORDS, decontam.PIECE, decontam.SHARD_BYTES), (60, 400, 500), (10**6, 400, 1)])
def test_every_window_is_found(spark, texts, items, monkeypatch, words, piece, shard):
    """One block and many, one shard and one per text; equal rows and a null key stay rows."""
    monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
    monkeypatch.setattr(decontam, "PIECE", piece)
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    docs = _table(spark, [*texts, texts[9]])
    found = decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    _check(found.collect(), [*texts, texts[9]], items)


def test_windows_cross_the_pieces_of_a_long_item(spark, texts, items, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 11)
    found = decontam.matches(_table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found:
        assert r.found.n_hit == len(_brute(r.row.text, items, decontam.WINDOW)[1])


def test_longest_match_names_its_first_place(spark):
    bench = spark.createDataFrame([("b", "k l m n o p q r s t u v"), ("a", "a b c d e f g h i j")], "item_id string, text string")
    docs = spark.createDataFrame([("a b c d e f g h i j z k l m n o p q r s t u v z k l m n o p q r s t u v",)], "text string")
    best = decontam.matches(docs, bench).first().found.longest
    assert (best.length, best.start, best.item) == (12, 11, "b")


def test_clean_removes_affected_rows_only(spark, texts, items):
    docs = _table(spark, texts)
    kept = decontam.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    want = [t for t in texts if not _brute(t, items, decontam.WINDOW)[1]]
    assert sorted((r.text for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, texts, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.found.n_hit == 0 and not r.found["items"] for r in decontam.matches(_table(spark, texts), none).collect())
    assert decontam.matches(_table(spark, texts).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(3)
    seq = np.append(rnd.integers(0, 4, 400), 0)
    stops = np.flatnonzero(seq == 0)
    room = stops[np.searchsorted(stops, np.arange(len(seq)))] - np.arange(len(seq))
    starts = np.flatnonzero(seq)
    order = decontam.suffix_array(seq, starts, room, 64)
    suffixes = [tuple(seq[p : p + room[p]]) for p in order]
    assert suffixes == sorted(suffixes) and sorted(order) == starts.tolist()
