"""Spelling groups, secret scan and vector codes against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import queries, secret_scan, spelling_groups, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- spelling groups ---------------------------------------------------------------------------

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v)) if others else None
        form = best if best and counts[best] >= ratio * n else None
        out[w] = (n, form, len(others), counts[form] if form else None)
    full = {}
    for w, (n, form, m, fn) in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        full[w] = (form, root, n, m, fn)
    return full


def noisy(texts):
    counts = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def vocabulary_of(seed, n=150):
    r = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(r.choice("abcdeé") for _ in range(r.randrange(7, 10)))
        words[w] = r.choice((2, 3, 20, 400))
        for _ in range(3):
            i, kind = r.randrange(len(w)), r.randrange(3)
            v = w[:i] + w[i + 1 :] if kind == 0 else w[:i] + r.choice("abzÿ") + w[i + (kind == 1) :]
            if len(v) >= 7:
                words.setdefault(v, r.choice((2, 3, 30)))
    return words


@pytest.mark.parametrize("shared", [32, 2, 0])
def test_groups_equal_all_pairs_at_every_level(spark, shared):
    words = vocabulary_of(1)
    vocab = spark.createDataFrame([*words.items()], "word string, n long")
    rows = spelling_groups.group(vocab, max_shared=shared).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain_groups(words)
    assert len(rows) == len(words)


def test_chains_of_forms_end_at_the_root(spark):
    words = {"aaaaaaab": 2, "aaaaaabb": 20, "aaaaabbb": 200, "aaaabbbb": 2000, "zzzzzzzz": 5}
    rows = spelling_groups.group(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    assert {r.word: r.root for r in rows} == {w: "aaaabbbb" if w[0] == "a" else w for w in words}


def test_ties_between_forms_go_to_the_smaller_word(spark):
    words = {"wordword": 2, "wordworz": 50, "wordworb": 50, "wordwor": 20}
    rows = spelling_groups.group(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    assert {r.word: r.form for r in rows}["wordword"] == "wordworb"


def test_words_of_documents(spark, documents):
    r = random.Random(5)
    vocab = [*vocabulary_of(3, 60)]
    texts = [(i, " ".join(r.choice(vocab).title() for _ in range(80)) + "\nshort Ünlauter x1y") for i in range(40)]
    texts += [(None, " ".join(vocab[:40])), (7, None), (8, ""), (9, texts[0][1]), (9, texts[0][1])]
    got = {r.word: r.n for r in spelling_groups.vocabulary(spelling_groups.noisy_words(documents(texts))).collect()}
    assert got == noisy(texts)
    assert any(len(w) != len(v) for w in got for v in vocab if near(w, v))
    empty = documents([])
    assert spelling_groups.group(spelling_groups.vocabulary(spelling_groups.noisy_words(empty))).count() == 0


def test_a_very_long_word(spark, documents):
    r = random.Random(9)
    word = "".join(r.choice("abcdefgh") for _ in range(20_000))
    texts = [(1, word), (2, word), (3, word[:-1] + "z"), (4, word[:-1] + "z"), (5, word[:500] + word[501:] + " " + word[:500] + word[501:])]
    rows = spelling_groups.group(spelling_groups.vocabulary(spelling_groups.noisy_words(documents(texts), divisor=10**12))).collect()
    by_length = sorted((len(r.word), r.n_near) for r in rows)
    assert by_length == [(19_999, 1), (20_000, 1), (20_000, 2)]


@pytest.mark.parametrize("symbols", [2, 5, 256])
def test_neighbourhoods_are_whole(symbols):
    word = [1, 0, 1, 1, 0]
    want = {tuple(word)}
    for i in range(len(word) + 1):
        want |= {tuple(word[:i] + [s] + word[i:]) for s in range(symbols)}
        if i < len(word):
            want.add(tuple(word[:i] + word[i + 1 :]))
            want |= {tuple(word[:i] + [s] + word[i + 1 :]) for s in range(symbols)}
    key = lambda w: int(spelling_groups.reduced_keys(np.array(w, np.int64), np.array([len(w)]), symbols)[0])
    got = {int(k) for _, keys in spelling_groups.neighbour_keys(np.array([word]), symbols) for k in keys}
    assert got == {key(w) for w in want} and len(got) == len(want)


# -- secret scan -------------------------------------------------------------------------------

R = random.Random(11)
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
RANDOM64 = "".join(R.choice(ALNUM) for _ in range(64))
HEX40 = "".join(R.choice("0123456789abcdef") for _ in range(40))


def plain_dense(text, window, limit):
    """Joined windows, each counted anew."""
    table = secret_scan.scaled_log(window)
    spans = []
    for i in range(len(text) - window + 1):
        if sum(int(table[c]) for c in Counter(text[i : i + window]).values()) <= limit:
            if spans and spans[-1][1] >= i:
                spans[-1] = (spans[-1][0], i + window)
            else:
                spans.append((i, i + window))
    return spans


def test_windows_equal_recounting(monkeypatch):
    r = random.Random(4)
    for chars, n in (("ab", 80), (ALNUM, 400), ("abcdefgh", 33), (ALNUM, 24)):
        text = "".join(r.choice(chars) for _ in range(n)) + "a" * 40 + "".join(r.choice(chars) for _ in range(n))
        limit = secret_scan.most_sum(24, 2.5 if len(chars) < 10 else 4.2)
        want = plain_dense(text, 24, limit)
        assert secret_scan.dense_spans(text, 24, limit, secret_scan.scaled_log(24)) == want
        with monkeypatch.context() as m:
            m.setattr(secret_scan, "BLOCK", 7)
            assert secret_scan.dense_spans(text, 24, limit, secret_scan.scaled_log(24)) == want


def spans_of(spark, documents, texts):
    rows = secret_scan.scan(documents([(i, t) for i, t in enumerate(texts)])).collect()
    by_id = {r["_doc"]["doc_id"]: r for r in rows}
    return [[(s.kind, s.first, s.last) for s in by_id[i]["_spans"]] for i in range(len(texts))], by_id


def test_kinds_and_places(spark, documents):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    texts = [f"é😀 PassWord: '{'x' * 6}' end", "token=abc", f"id {key} {key[:-1]}", f"sha {HEX40}", HEX40.upper(), f"see {RANDOM64}.",
             f'api_key = "{HEX40}"', "paſſword=abcdefgh", "token : \n abcdefgh", None, "", f"secret=token={'y' * 9}"]
    got, _ = spans_of(spark, documents, texts)
    at = texts[0].index("P")
    assert got[0] == [("assign", at, texts[0].index("x") + 6)]
    assert got[1] == []
    assert got[2] == [("access", 3, 23)]
    assert got[3] == [("hex", 4, 44)]
    assert [k for k, _, _ in got[4]] == ["entropy_hex"]
    assert [k for k, _, _ in got[5]] == ["entropy_alnum"] and got[5][0][1] >= 4 and got[5][0][2] <= 68
    assert got[6] == [("assign", 0, 11 + 40), ("hex", 11, 51)]  # base spans stay, also where they overlap
    assert got[7] == got[8] == got[9] == got[10] == []
    assert got[11] == [("assign", 0, 22)]


def test_allow_list_and_prose_stay_silent(spark, documents):
    prose = "Donaudampfschifffahrtsgesellschaftskapitaenswitwe usr/local/lib/python3/site-packages/pandas/core/frame"
    texts = [prose, "https://a.test/" + RANDOM64, "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "z" * 5000, "well-known-words-of-a-slug-with-2024-in-it", "0123456789" * 9, "EXAMPLE" + RANDOM64, "4444555566667777" * 3]
    got, _ = spans_of(spark, documents, texts)
    assert [bool(g) for g in got] == [False, True, False, False, False, True, False, True]  # digits alone are hex: base kind
    assert {k for g in (got[5], got[7]) for k, _, _ in g} == {"hex"}
    assert got[1][0][0].startswith("entropy")
    suppressed = secret_scan.Scanner(allowed=(*secret_scan.ALLOWED, RANDOM64[10:30]))
    assert suppressed.spans(texts[1])[1] == []


def test_scan_takes_repeats_clashes_and_long_texts(spark, documents):
    long = ("plain words and more " * 60_000) + HEX40 + (" tail" * 10_000)
    rows = [(1, long), (2, HEX40), (2, HEX40), (None, HEX40), (3, None), (4, "")]
    out = secret_scan.scan(documents(rows)).collect()
    assert sorted((r["_doc"]["doc_id"] is None, r["_doc"]["doc_id"] or 0, len(r["_spans"])) for r in out) == [
        (False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 0), (False, 4, 0), (True, 0, 1)]
    assert next(r for r in out if r["_doc"]["doc_id"] == 1)["_spans"][0]["first"] == long.index(HEX40)
    assert {r["_doc"]["_spans"] for r in out} == {"_spans"}  # the table's own column of that name
    assert secret_scan.scan(documents([])).count() == 0


def test_redaction_masks_every_span_once(spark, documents):
    texts = [f'é token = "{HEX40}" and {RANDOM64} end', "nothing", None, f"{HEX40}"]
    out = {r.doc_id: r.text for r in secret_scan.redacted(documents([*enumerate(texts)])).collect()}
    assert out[1] == "nothing" and out[2] is None and out[3] == "[secret]"
    assert out[0].startswith('é [secret]" and [secret]') and out[0].endswith(" end") and HEX40 not in out[0]


# -- vector codes ------------------------------------------------------------------------------

def plain_codes(rows, parts, entries, rounds, scale=4096):
    """Every round scans every entry."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])),
                  key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[int(np.floor(scale * v)) for v in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    for t in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if t < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        book[p, e] = own.sum(axis=0) // len(own)
    return [(r[0], bytes(c.astype(np.uint8)), int(m)) for r, c, m in zip(kept, code, d.min(axis=2).sum(axis=1))], book


def vectors_of(seed, n, length, grain=None):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, length)) + r.integers(-2, 3, size=(n, 1))
    return (np.round(v / grain) * grain if grain else v).astype(np.float32)


@pytest.mark.parametrize("grain, n", [(None, 700), (0.5, 700), (None, 11), (1.0, 300)])
def test_codes_equal_full_scans(spark, grain, n):
    v = vectors_of(3, n, 16, grain)  # a grain makes ties and equal vectors
    rows = [(i, row.tolist(), i % 3 or None) for i, row in enumerate(v)]
    rows += [(-1, None, 1), (-2, [float("nan")] + [0.0] * 15, 1), (-3, [None] + [0.0] * 15, 2), (-4, [float("inf")] * 16, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, error int")
    coded, books = vector_codes.quantize(df.repartition(5))
    want, book = plain_codes(rows, 8, 16, 6)
    got = vector_codes.with_label_error(coded).collect()
    assert sorted((r.id, bytes(r.codes), r.error) for r in got) == sorted(want)
    assert (books[-1] == book).all() and len(books) == 7
    sums = defaultdict(int)
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got) and None in sums
    assert vector_codes.book_digest(book) == hashlib.sha256(",".join(str(int(c)) for c in book.reshape(-1)).encode()).hexdigest()


def test_net_bounds_are_right_and_save_scans():
    r = np.random.default_rng(1)
    x = np.floor(4096 * (r.normal(size=(4000, 8)) + 6 * r.integers(0, 8, size=(4000, 1)))).astype(np.int64)
    books = [x[None, :8].copy()]
    code, stamps = np.zeros(len(x), np.int64), np.zeros((len(x), 2), np.int64)
    bounds = np.zeros((len(x), 2))
    bounds[:, 0] = np.inf
    scanned = []
    for _ in range(8):
        moves = vector_codes.Moves(books)
        _, n = vector_codes.assign_part(x, 0, books, moves, code, stamps, bounds)
        scanned.append(n)
        d = vector_codes.squared(x, books[-1][0])
        assert (code == d.argmin(axis=1)).all()
        up = bounds[:, 0] + moves.own[stamps[:, 0], 0, code]
        low = bounds[:, 1] - moves.others(stamps[:, 1], 0, code)
        own = np.take_along_axis(d, code[:, None], 1)[:, 0]
        np.put_along_axis(d, code[:, None], np.iinfo(np.int64).max, 1)
        assert (up >= np.sqrt(own) - 1e-6).all() and (low <= np.sqrt(d.min(axis=1)) + 1e-6).all()
        means = np.stack([x[code == e].sum(axis=0) // max(1, (code == e).sum()) for e in range(8)])
        books.append(np.where(np.bincount(code, minlength=8)[:, None] > 0, means, books[-1][0])[None])
    assert scanned[0] == len(x) and scanned[-1] < len(x) / 2


def test_net_displacement_is_tighter_than_summed_drifts():
    books = [np.array([[[0, 0], [50, 50]]]), np.array([[[30, 0], [50, 50]]]), np.array([[[2, 0], [50, 50]]])]
    moves = vector_codes.Moves(books)
    assert moves.own[0, 0, 0] == pytest.approx(2) and moves.own[1, 0, 0] == pytest.approx(28)  # drifts would sum to 58


def test_vectors_that_cannot_be_coded(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        vector_codes.quantize(make([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)]))
    with pytest.raises(ValueError):
        vector_codes.quantize(make([(1, [0.0] * 9, 1)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.quantize(make([(1, [1e30] * 8, 1)]))
    coded, _ = vector_codes.quantize(make([]))
    assert coded.columns == ["id", "label", "codes", "error"] and coded.count() == 0
    coded, _ = vector_codes.quantize(make([(5, [0.25] * 8, None), (5, [0.25] * 8, None), (None, [0.5] * 8, 1)]))
    assert sorted((r.id or 0, bytes(r.codes), r.error) for r in coded.collect()) == [(0, bytes([2] * 8), 0), (5, bytes(8), 0), (5, bytes(8), 0)]
    coded, _ = vector_codes.quantize(make([(1, [], 1), (2, None, 1)]))
    assert [(r.id, bytes(r.codes), r.error) for r in coded.collect()] == [(1, bytes(8), 0)]


def test_whole_queries_on_an_empty_folder(spark, tmp_path, documents):
    d = str(tmp_path)
    documents([]).select("doc_id", "text").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    for name in ("op11_spelling_groups", "op12_secret_scan", "op13_vector_codes"):
        assert queries.QUERIES[name](spark, d).count() == 0
