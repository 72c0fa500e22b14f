"""The training-data operators against brute force on small, awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from sparkcurate.llm import bpe, licences, mixing, quality, rules, sharding, shingles, simhash, suffixes, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, score string, tid string, number long"


def _words(rnd, n):
    return " ".join(rnd.choice("alpha Beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Null, empty, blank, long, equal and close texts, and one that is long and periodic."""
    rnd = random.Random(7)
    base = _words(rnd, 120)
    close = [base.replace(base.split()[i], "other", 1) for i in range(0, 60, 5)]
    passage = _words(rnd, 80)
    shared = [_words(rnd, 20) + " " + passage + " " + _words(rnd, 30) for _ in range(5)]
    return [None, "", " \n\t ", "é", "one two", "x" * 900, "ab " * 400, _words(rnd, 6000), *[base] * 6, *close, *shared, *[_words(rnd, rnd.randint(1, 200)) for _ in range(20)]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with extra columns whose names clash with those inside the operators, and a null key."""
    rows = [(i if i != 3 else None, t, "en", None if i % 3 else "big", len(t or ""), "f", "r", "s", "t", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------------- simhash


def _print(text):
    parts = (text or "").encode().translate(simhash.LOWER).split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_components(docs, texts):
    prints = [_print(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = defaultdict(list)
    for i, r in enumerate(_components(len(texts), links)):
        groups[r].append(i)
    want = Counter()
    for own in groups.values():
        keys = [i for i in own if i != 3]
        for i in own:
            want[(i if i != 3 else None, f"{prints[i]:016x}", min(keys, default=None))] += 1
    got = Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want and len(links) > 20


def test_simhash_keeps_one_row_of_each_group(docs, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.component_id for r in simhash.near_duplicates(docs).collect()]
    assert kept.count() == len(set(ids))
    assert simhash.keep_one(docs.union(docs)).count() == kept.count()
    assert simhash.keep_one(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_simhash_links_in_dense_lists(spark):
    rnd = random.Random(1)
    around = {0x0F0F << 20}
    while len(around) < 150:
        around.add(rnd.choice(sorted(around)) ^ 1 << rnd.randint(0, 63) ^ 1 << rnd.randint(0, 63))
    signed = [x - 2**64 if x >= 2**63 else x for x in around]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 3}
    for dense in (2, 1000):
        got = [(r.a, r.b) for r in simhash.links(fps, dense=dense).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def _shingles(text):
    parts = (text or "").encode().translate(simhash.LOWER).split()
    return frozenset(b" ".join(parts[i : i + 5]) for i in range(len(parts) - 4)) or frozenset([b" ".join(parts)] if parts else [])


def _alike_groups(texts):
    sets = [_shingles(t) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0]
    return _components(len(sets), near)


@pytest.mark.parametrize("few", [shingles.FEW, -1])
def test_shingles_reach_similarity_of_four_fifths(spark, docs, texts, nothing, monkeypatch, few):
    """Near copies of more than three bits meet; every round and the pairs left after them agree."""
    monkeypatch.setattr(shingles, "FEW", few)
    rnd = random.Random(11)
    near = list(texts)
    for n in (40, 150, 600):
        base = _words(rnd, n).split()
        near += [" ".join(base)] + [" ".join("new" if i in cut else w for i, w in enumerate(base)) for k in (1, 2, 3) for cut in [rnd.sample(range(n), max(1, k * n // 150))]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(near)], "doc_id long, text string").repartition(3)
    roots = _alike_groups(near)
    assert sorted(r.doc_id for r in shingles.keep_one(frame).collect()) == sorted(set(roots))
    far = [(a, b) for a, b in itertools.combinations(range(len(texts), len(near)), 2) if roots[a] == roots[b] and (_print(near[a]) ^ _print(near[b])).bit_count() > 3]
    assert far
    if few >= 0:
        kept = shingles.keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(_alike_groups(texts)))
        assert shingles.keep_one(docs.union(docs)).count() == kept.count() and shingles.keep_one(nothing).count() == 0


def test_a_crowd_below_four_fifths_is_not_paired_up(spark, monkeypatch):
    """Variants of one text, each with three words of its own changed, are some 0.66 similar: parities tell them apart
    before any set is looked at, and never part sets of 0.8."""
    rnd = random.Random(5)
    base = _words(rnd, 150).split()
    texts = [" ".join(f"own{v}" if i in cut else w for i, w in enumerate(base)) for v in range(60) for cut in [[20 + v % 20, 70 + v % 19, 120 + v % 17]]]
    sets = [shingles.shingles_of(t) for t in texts + [" ".join([*base, *["more"] * k]) for k in range(30)]]
    for x, y in itertools.combinations(sets, 2):
        flips = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(shingles.parity_of(x), shingles.parity_of(y)))
        assert flips <= len(np.setxor1d(x, y))
    seen, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *more: (seen.append(pairs.distinct().count()), verified(pairs, *more))[1])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.keep_one(frame).collect()) == sorted(set(_alike_groups(texts)))
    assert sum(seen) < 300


def test_near_copies_that_no_mask_meets_are_found(spark):
    """Some pairs at 0.8 share no mask or differ in more than ``FAR`` bits; one of each stays all the same."""
    rnd, texts, masks = random.Random(8), [], shingles.masks_for(100)
    for n in range(2000):
        base = _words(rnd, 20 + n % 60)
        own = max(1, (16 + n % 60) // 9)
        pair = [base + " " + _words(rnd, own) for _ in range(2)]
        one, two = map(shingles.shingles_of, pair)
        x, y = shingles.simhash_of(one), shingles.simhash_of(two)
        apart = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
        met = apart <= shingles.FAR and any((x[0] ^ y[0]) & m == 0 == (x[1] ^ y[1]) & k for m, k in masks)
        if not met and len(np.intersect1d(one, two)) >= 0.8 * len(np.union1d(one, two)):
            texts += pair
    lost = len(texts)
    assert 4 <= lost <= 200
    texts += [t for t in texts[:4] for _ in range(3)] + ["", None, "one two", "a b c d e f g h", "a b c d e f g h i"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = [*range(0, lost, 2), lost + 12, lost + 14, lost + 15]
    assert sorted(r.doc_id for r in shingles.keep_one(frame).collect()) == kept


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_similar_sets_share_a_mark(least):
    rnd = np.random.default_rng(4)
    for n in [1, 2, 4, 5, 7, 8, 9, 16, 31, 32, 63, 64, 100, 255, 600]:
        more = int(n / least + 1e-9) - n
        both = max(k for k in range(n) if (n - k) / (n + k) >= least)
        for gone, new in [(0, more), (n - math.ceil(n * least - 1e-9), 0), (both, both), (both // 2, both // 2)] * 10:
            x = np.unique(rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([rnd.permutation(x)[gone:], rnd.integers(0, 1 << 63, new, np.uint64)]))
            assert len(np.intersect1d(x, y)) >= least * len(np.union1d(x, y)) - 1e-9
            if len(np.setxor1d(x, y)):
                assert len(np.intersect1d(shingles.marks_of(x, least), shingles.marks_of(y, least)))
    few = np.arange(8, dtype=np.uint64)  # all in one bin, so empty bins have to stand in
    assert len(np.intersect1d(shingles.marks_of(few, least), shingles.marks_of(few[1:], least))) or least == 0.9
    assert len(shingles.marks_of(few[:0], least)) == 0


# ------------------------------------------------------------------------ suffixes


def _cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))[: len(b)]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 19, 700])
def test_suffix_spans(spark, docs, texts, tmp_path, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffixes, "SLICE", slice_bytes)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.query(spark, str(tmp_path)).collect()}
    for i, (n, removed, spans, kept) in enumerate(_cut(texts, 400)):
        assert got[i if i != 3 else None] == (n, removed, spans, hashlib.sha256(kept).hexdigest()), i
    assert sum(x[1] for x in got.values()) > 5000


def test_suffix_nul_bytes_and_names(spark):
    """Runs of NUL are strings like others; a shared first name alone removes nothing."""
    texts = ["a" * 10 + "\0" * 450, "b" * 10 + "\0" * 420, "c" * 420, "d" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.tid: (r.n_removed, r.kept) for r in suffixes.repeats(rows).collect()}
    want = {hashlib.sha256(t.encode()).hexdigest(): (n, kept) for t, (_, n, _, kept) in zip(texts, _cut(texts, 400)) if n}
    assert got == want and len(want) == 3
    names, again, place = suffixes.grouped(np.array([[5, 1], [5, 2], [4, 9], [5, 1]], np.uint64))
    assert names.tolist() == [[4, 9], [5, 1], [5, 2]] and again.tolist() == [False, True, False] and place.tolist() == [1, 2, 0, 1]


def test_suffix_texts(docs, texts, nothing):
    out = suffixes.without_repeats(docs, length=64, size="n_chars")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, (_, removed, _, kept) in enumerate(_cut(texts, 64)):
        own = got[i if i != 3 else None]
        assert own.text == (kept.decode("utf-8", "ignore") if removed else texts[i])
        assert own.n_chars == len(own.text or "")
    assert suffixes.without_repeats(nothing).count() == 0


def test_planted_passages_are_removed(spark, tmp_path):
    """Passages of 400 bytes and more that stand in several texts go, shorter ones and clean texts stay."""
    rnd = random.Random(17)

    def some(n):
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    planted, rows = {}, []
    for size in (399, 400, 401, 650, 3000):
        passage = f"#{some(size - 2)}#"
        for mark in "ABC":  # so that no copy goes on beyond the passage
            planted[len(rows)] = size
            rows.append((len(rows), f"{some(200)}{mark}{passage}{mark}{some(200)}"))
    clean = range(len(rows), len(rows) + 20)
    rows += [(i, some(900)) for i in clean]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffixes.query(spark, str(tmp_path)).collect()}
    assert all(got[i].n_removed == (size if size >= 400 else 0) for i, size in planted.items())
    assert all(got[i].removed == (size >= 400) and got[i].n_kept == got[i].n_bytes - got[i].n_removed for i, size in planted.items())
    assert not any(got[i].removed for i in clean)


# ----------------------------------------------------------------------------- bpe


@pytest.mark.parametrize("chunk", [bpe.CHUNK_BYTES, 3000])
def test_bpe_is_tiktoken(spark, docs, texts, nothing, monkeypatch, chunk):
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["it's <|endoftext|> \x1c\x1d x", "  \u00a0\u2003 \u017f\u2019s", "日本語 ١٢ ½\n\n ", "\U0001f600" * 70, "y" * 9000, "\r\n\t a"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    want = sorted((known.encode_ordinary(t or ""), (t or "").encode()) for t in [*texts, *odd])
    rows = bpe.decode(bpe.encode(both, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted((r.ids, bytes(r.bytes)) for r in rows) == want
    assert {r.doc_id: r.ids for r in rows}[1000] == known.encode_ordinary(odd[0])
    assert bpe.digest(nothing).count() == 0


def test_bpe_of_texts_in_pieces(spark):
    """Texts above ``LONG_TEXT`` travel in pieces, two of them with one key."""
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    long = [" ".join(rnd.choices(["alpha", "don't", "  ", "42", "naïve", "\n"], k=n)) for n in (600_000, 400_000)]
    texts = [long[0], long[1], "short", None, "w" * (bpe.LONG_TEXT + 10)]
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = bpe.encode(rows, ranks, public_tokenizers.PATTERN).collect()
    want = [(i // 2, known.encode_ordinary(t or "")) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31, 2**34])
    assert (bpe.unpack(bpe.pack(x)) == x).all() and len(bpe.unpack(bpe.pack(x[:0]))) == 0


# ------------------------------------------------------------------------ sharding


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1234])
def test_shards_are_even_and_reproducible(spark, n):
    rows = spark.range(n).selectExpr("if(id % 3 = 0, null, id) as k", "id % 2 as v")
    got = sorted((str(r.k), r.v, r.shard, r.slot) for r in sharding.shard(rows, 5).collect())
    again = sorted((str(r.k), r.v, r.shard, r.slot) for r in sharding.shard(rows.repartition(7), 5).collect())
    assert got == again and len(got) == n
    assert {(s, t) for _, _, s, t in got} == {(i % 5, i // 5) for i in range(n)}


def test_shards_of_equal_rows_and_numbers(spark, docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    rows = spark.range(40).selectExpr("cast(null as long) as k")
    assert {(r.shard, r.slot) for r in sharding.shard(rows, 4).collect()} == {(i % 4, i // 4) for i in range(40)}
    places = spark.range(999).select(sharding.permuted(sharding.F.col("id"), 999, 5).alias("p")).collect()
    order = [r.p for r in places]
    assert sorted(order) == list(range(999)) and abs(np.corrcoef(order, range(999))[0, 1]) < 0.15
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in sharding.query(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id if r.doc_id is not None else 3] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


# ---------------------------------------------------------------------------- urls


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("HTTP://A.Org", "a.org", "", None, "allow"),
        ("https://ORG/x", "org", "/x", "org/", "allow"),
        ("https://b.example.org/es/1", "b.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("http://e.com/fr/#a", "e.com", "/fr/", "com/fr/", "allow"),
        ("http://e.com/de/", "e.com", "/de/", "com/de/", "block"),
        ("a://b://c/d?e", "b:", "//c/d", None, "allow"),
        ("http://x.EXAMPLE.ORG?es/", "x.example.org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    hosts = {"bad.net": (80, 78), "two.net": (2, 2), "good.net": (100, 1), "a.io": (50, 2), "new.net": (0, 0)}
    pages, marks = [], []
    for host, (n, bad) in hosts.items():
        for i in range(max(1, n)):
            pages.append((len(pages), f"https://{host}/{i}"))
            marks += [(len(pages) - 1, i < bad)] if n else [(len(pages) - 1, None)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "page long, bad boolean"))
    rows = {r.host: r for r in out.collect()}
    assert out.count() == len(pages)
    assert {h: r.verdict for h, r in rows.items()} | {"two.net": ""} == {"bad.net": "block", "two.net": "", "good.net": "allow", "a.io": "allow", "new.net": rows["new.net"].verdict}
    assert rows["good.net"].lower < rows["two.net"].lower < rows["bad.net"].lower


def test_sql_twin_blocks_what_earned_it(spark, tmp_path):
    """A bad host, one with a single bad page, clean ones, and one without labels."""
    from tests.oracle import _rows

    rnd = random.Random(9)
    hosts = {"bad.net": (120, 110), "one.net": (1, 1), "good.net": (300, 6), "a.example.io": (90, 3), "b.example.io": (60, 55), "new.net": (0, 0)}
    pages, labels = [], []
    for host, (n, bad) in hosts.items():
        for i in range(max(3, n)):
            if i < n:
                labels.append((len(pages), 0 if i < bad else 1, rnd.choice([0, 0, None])))
            pages.append((len(pages), f"https://{host}/{i}"))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = urls.query(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    cur = con.execute(urls.SQL)
    got = _rows(out.columns, [tuple(r) for r in out.collect()])
    assert got == _rows([d[0] for d in cur.description], cur.fetchall())
    assert {r.host for r in out.filter("verdict = 'block'").collect()} == {"bad.net", "b.example.io"}


def test_long_texts_of_few_words_fail():
    """The bound on distinct words grows with the text: no length escapes it."""
    rule = next(r for r in rules.RULES if r.name == "few_distinct_words")
    con = duckdb.connect()

    def fails(n, distinct):
        return con.execute(f"SELECT {rule.failed} FROM (SELECT {n} AS n_words, {distinct} AS n_distinct_words)").fetchone()[0]

    assert fails(2000, 199) and not fails(2000, 200)
    assert fails(2001, 199) and fails(20_000, 600) and not fails(20_000, 700) and not fails(49, 1)


@pytest.mark.parametrize("share", [0.3, 0.5])
def test_bad_corpora_block_only_what_earned_it(spark, share):
    """Hosts that hardly differ get the strongest prior; it blocks nobody without own evidence."""
    counts = [(f"h{i}.d{i % 4}.net", 100, round(100 * share)) for i in range(40)]
    counts += [("new.d1.net", 0, 0), ("clean.d1.net", 1, 0), ("few.d1.net", 1, 1), ("alone.com", 0, 0), ("worst.org", 400, 390)]
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(counts, "host string, n long, bad long")).collect()}
    assert got["new.d1.net"].lower > urls.LIMIT
    blocked = {h for h, r in got.items() if r.lower > urls.LIMIT and r.earned}
    assert "worst.org" in blocked and blocked.isdisjoint({"new.d1.net", "clean.d1.net", "few.d1.net", "alone.com"})
    pages = [(0, "https://new.d1.net/"), (1, "https://alone.com/x")] + [(i, f"https://h{i % 40}.d{i % 4}.net/{i}") for i in range(2, 2002)]
    marks = [(i, i // 40 % 10 < 10 * share) for i in range(2, 2002)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "page long, bad boolean"))
    assert {r.verdict for r in out.filter("page_id < 2").collect()} == {"allow"}


# --------------------------------------------------------------------------- rules


def test_rules_measure():
    assert rules.measure("a b c a b c a b c\n\nx # y\nx # y") == (15, 15, 2, 3, 1, 15, 6, 0)
    assert rules.measure(None) == rules.measure("") == (0,) * 8
    assert rules.measure("a a a a")[5] == 4 and rules.measure("a b c d")[5] == 0


def test_rule_ledger_and_ablation(docs, nothing, texts):
    entries = rules.ledger(docs)
    rows = entries.collect()
    assert len(rows) == len(texts) and rules.ledger(nothing).count() == 0
    for r in rows:
        for rule in rules.RULES:
            failed = eval(rule.failed.replace(" = ", " == ").replace("n_words between 50 and 2000", "50 <= n_words <= 2000"), {}, r.asDict())
            assert bool(r.failures >> rule.bit & 1) == failed, (rule, r)
    got = {r.rule: (r.failed, r.alone) for r in rules.ablation(entries, "strict-1").collect()}
    whole = rules.mask(rules.POLICIES["strict-1"])
    for rule in rules.RULES[:6]:
        sets = [r.failures & whole for r in rows]
        assert got[rule.name] == (sum(bool(s >> rule.bit & 1) for s in sets), sum(s == 1 << rule.bit for s in sets))


# ------------------------------------------------------------------------- vectors


@pytest.mark.parametrize("cell,block", [(2000, 2048), (6, 4)])
def test_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(90):
        v = rnd.normal(size=3 if i % 7 else 4)
        rows.append((i, i % 2 if i % 11 else None, [float(x) for x in v]))
    rows += [(100 + i, 1, rows[1][2]) for i in range(5)] + [(110, 1, None), (111, 1, [0.0, 0.0, 0.0]), (112, 1, [1.0, None, 1.0]), (113, 0, [float("nan"), 1.0, 1.0]), (114, 0, [float("inf"), 1.0, 1.0]), (115, 0, []), (116, 1, [2 * x for x in rows[1][2]])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")

    def good(r):
        return r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])

    links = []
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if good(a) and good(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
            x, y = np.array(a[2]), np.array(b[2])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((i, j))
    roots = _components(len(rows), links)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    degree = Counter(itertools.chain(*links))
    want = sorted((r[0], degree[i], least[roots[i]], r[0] == least[roots[i]]) for i, r in enumerate(rows))
    assert sorted(map(tuple, vectors.near_duplicates(frame).collect())) == want and len(links) > 30
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


# ------------------------------------------------------------------------- quality


def test_cotraining_on_held_out_rows(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    assert len(model.rounds) == quality.ROUNDS and min(model.rounds[0]) > 0
    rest = quality.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("score", "quality").collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in rest]
    assert np.mean(right) > 0.95
    assert np.mean([r.score >= 0.5 for r in rest if r.quality == 1]) > 0.97


def test_cotraining_picks_from_all_texts_and_sources(spark, monkeypatch):
    """Copies count once, and a rare source is picked beside a large one."""
    monkeypatch.setattr(quality, "PICKS", 20)
    rnd = random.Random(2)
    rows = [(i, "spam buy " * 9 if i < 900 else f"spam buy now {_words(rnd, 6)}", "en", "big") for i in range(1000)]
    rows += [(1000 + i, f"spam buy rare {_words(rnd, 6)}", "xx", "rare") for i in range(3)]
    every = quality._features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id")
    sure = [np.concatenate([np.zeros(n), [-9.0]]) for n in (quality.WORDS, quality.META)]
    got = [tuple(r) for r in quality._picks(every, None, sure, (0.5, 0.5), [set(), set()]).collect()]
    assert len(got) == len(set(got)) == 20 and {x[2] for x in got} == {0}
    keys = defaultdict(list)
    for r in every.select("key", "digest").collect():
        keys[r.digest].append(r.key)
    for view in (0, 1):
        assert sum(keys[d][0] >= 1000 for v, d, _ in got if v == view) == 3


def test_quality_without_usable_labels(spark, docs, nothing, texts):
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (one, none):
        kept = quality.accepted(docs, labels)
        assert kept.columns == docs.columns and kept.count() == len(texts)
    both = spark.createDataFrame([(i, int(i > 20)) for i in range(1, 40)] + [(None, 1), (2, None)], "doc_id long, quality int")
    assert quality.score(docs.drop("score"), quality.train(docs, both)).filter("score is null").count() == 0
    assert quality.accepted(nothing, both).count() == 0


# -------------------------------------------------------------------------- mixing


def _mix_rows(spark, sizes, words):
    rnd = random.Random(5)
    rows = [(s, f"{s}{i}", _words(rnd, words(i))) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(i, t, s) for i, (s, _, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(6)


def test_mixing_budgets(spark, nothing):
    docs = _mix_rows(spark, {"big": 300, "mid": 60, "small": 20, None: 10}, lambda i: 5 + i % 7)
    counts = {r.source: r.t for r in docs.groupBy("source").agg(mixing.F.sum(mixing.word_count(mixing.F.col("text"))).alias("t")).collect()}
    out = mixing.mixed(docs, entropy=0.95).cache()
    rows = out.select("row.doc_id", "row.source", "n_tokens", "weight", "epoch", "block_key", "doc_key").collect()
    total = sum(counts.values())
    weights = {r.source: r.weight for r in rows}
    p = np.array(list(weights.values()))
    assert abs(p.sum() - 1) < 1e-9 and abs(-(p * np.log(p)).sum() / np.log(4) - 0.95) < 1e-4
    for source, weight in weights.items():
        own = [r for r in rows if r.source == source]
        budget = int(total * weight)
        assert 0 <= sum(r.n_tokens for r in own) - budget <= 11
        whole = budget // counts[source]
        for epoch in range(whole):
            ids = [r.doc_id for r in own if r.epoch == epoch]
            assert len(ids) == len(set(ids)) == docs.filter(mixing.F.col("source").eqNullSafe(source)).count()
        assert {r.epoch for r in own} <= set(range(whole + 1))
    again = mixing.mixed(docs.repartition(3), entropy=0.95).select("row.doc_id", "epoch").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.epoch) for r in rows)
    assert mixing.mixed(nothing, entropy=0.9).count() == 0


def test_mixing_limits_epochs_and_takes_awkward_rows(spark, docs, texts):
    some = _mix_rows(spark, {"big": 200, "small": 4}, lambda i: 10)
    epochs = mixing.mixed(some, epochs=3.0).groupBy("row.source").agg((mixing.F.sum("n_tokens") / {"big": 2000, "small": 40}["small"]).alias("e")).collect()
    assert {r.source: r.e for r in epochs}["small"] == pytest.approx(3.0, abs=0.3)
    as_is = mixing.mixed(docs, entropy=0.0)
    assert as_is.select("row.*").columns == docs.columns and as_is.count() >= len(texts) - 3


# ------------------------------------------------------------------------ licences


def _dense(scanner, terms):
    """Cosine by whole vectors, without postings or key terms."""
    best = 0.0
    for _, text in licences.TEMPLATES:
        a, b = Counter(terms), Counter(licences.TERM.findall(text.lower()))
        wa = {t: n * scanner.idf.get(t, scanner.unknown) for t, n in a.items()}
        wb = {t: n * scanner.idf[t] for t, n in b.items()}
        dot = sum(w * wb.get(t, 0.0) for t, w in wa.items())
        best = max(best, dot / (np.sqrt(sum(w * w for w in wa.values())) * np.sqrt(sum(w * w for w in wb.values()))))
    return best


def test_licence_key_terms_lose_nothing():
    scanner = licences.Scanner()
    every = sorted({t for _, x in licences.TEMPLATES for t in licences.TERM.findall(x.lower())}) + ["lorem", "ipsum"]
    rnd = random.Random(4)
    for _ in range(1500):
        _, text = rnd.choice(licences.TEMPLATES)
        terms = [t for t in licences.TERM.findall(text.lower()) if rnd.random() < 0.7] + rnd.sample(every, rnd.randint(0, 4))
        if terms and _dense(scanner, terms) >= scanner.least + 1e-9:
            assert not scanner.key.isdisjoint(terms)
            assert scanner.weigh(terms)[0] == pytest.approx(_dense(scanner, terms))


def test_licences_are_told_from_their_relatives():
    scanner = licences.Scanner()
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bsd, third = licences._BSD, "Neither the name of Example Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    filler = " ".join(f"word{i}" for i in range(40))
    want = {
        gnu.format("program", "", 2): "GPL-2.0",
        gnu.format("program", "", 3): "GPL-3.0",
        gnu.format("program", "Affero ", 3): "AGPL-3.0",
        gnu.format("library", "Lesser ", 3): "LGPL-3.0",
        gnu.format("library", "Lesser ", "2.1"): "LGPL-2.1",
        bsd.replace(": ", ":\n\n").replace(". ", ".\n\n"): "BSD-2-Clause",
        bsd + "\n\n" + third: "BSD-3-Clause",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
        "Viel mit Worten": None,
        filler: None,
    }
    for kind in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND"):
        want[f"Licensed under CC BY{kind} 4.0."] = want[f"{filler} Licensed under CC BY{kind} 4.0. {filler}"] = f"CC-BY{kind}-4.0"
    assert {text: scanner.scan(text)[0] for text in want} == want
    for name, text in licences.TEMPLATES:
        assert scanner.scan(text)[0] == name, text


def test_licences_inherit_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/c/x", None),
        (3, "a/b/COPYING", gpl + "\n" + filler),
        (4, "a/b/c/y", filler),
        (5, "a/z", filler + "\n" + gpl),
        (6, "q/z", ""),
        (7, None, filler),
        (8, "a/z", filler),
        (8, "a/z", filler),
        (9, "top", filler),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, licence string")
    got = Counter((r.doc_id, r.licence, r.is_licence_file, r.inherited_from) for r in licences.scan(files).collect())
    assert got == Counter([
        (1, "MIT", True, None),
        (2, "GPL-3.0", False, "a/b"),
        (3, "GPL-3.0", True, None),
        (4, "GPL-3.0", False, "a/b"),
        (5, "GPL-3.0", False, None),
        (6, None, False, None),
        (7, None, False, None),
        (8, "MIT", False, "a"),
        (8, "MIT", False, "a"),
        (9, None, False, None),
    ])
    assert licences.scan(files.limit(0)).count() == 0


# ------------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "stage")
        assert docs.columns == start and docs.count() > 0, name
    last = sorted(tuple(r) for r in corpus_pipeline.tokens(spark, docs, sf).collect())
    assert last == sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert sorted(x[3] for x in last) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect())


def test_queries_with_sql_twins(spark, duck):
    import __spark_entry__ as entry
    from sparkcurate.llm.queries import ORACLES, QUERIES
    from tests.oracle import compare, connect

    sf = "/root/testdata/sf0.001"
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    for name, sql in ORACLES.items():
        ok, told, *_ = compare(spark, connect(sf), name, QUERIES[name], sql, sf)
        assert ok, (name, told)


def test_pipeline_meets_near_duplicates_by_simhash():
    """Close sets share a mask of their fingerprints, sets without a common shingle differ in too many bits."""
    rnd = random.Random(3)
    masks, missed, near = shingles.masks_for(200_000), 0, 0
    for _ in range(300):
        base = [rnd.getrandbits(64) for _ in range(170)]
        a, b = base[:153], base[:136] + base[153:]  # 136 of 170: 0.8
        x, y = (shingles.simhash_of(np.array(sorted(s), np.uint64)) for s in (a, b))
        apart = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
        missed += apart > shingles.FAR or not any((x[0] ^ y[0]) & m == 0 == (x[1] ^ y[1]) & k for m, k in masks)
        z = shingles.simhash_of(np.array([rnd.getrandbits(64) for _ in range(153)], np.uint64))
        near += sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, z)) <= shingles.FAR
    assert missed <= 30 and near == 0
    votes = np.array([3, 1, 2], np.uint64)
    assert shingles.simhash_of(votes)[0] == 3 and shingles.simhash_of(votes[:0]) == (0, 0)


def test_pipeline_stages_remove_the_tables_of_the_stage_before(spark, docs):
    import corpus_pipeline
    from sparkcurate.session import exists, materialise, new_path

    made = []

    def stage(spark, docs, sf_dir):
        made.append(new_path(spark, "own"))
        docs.select("doc_id").write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    first = corpus_pipeline._tidy(stage)(spark, docs, "")
    second = corpus_pipeline._tidy(stage)(spark, first, "")  # still reads the first
    assert exists(spark, made[0])
    corpus_pipeline._tidy(stage)(spark, materialise(second, "result"), "")
    assert not exists(spark, made[0]) and not exists(spark, made[1]) and exists(spark, made[2])
