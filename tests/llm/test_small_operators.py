"""Packing, chunk dedup, id files, line runs, decontamination and quality rules against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from ledgerlens.llm import cdc, decontaminate, line_runs, packing, quality_rules, queries, rans, tokens

EDGES = ["", "a  b", " x", "x ", " x \n y", "a\n\nb", "don't they're 'll", "é à ü ñ ß İstanbul", "x\0y", "a \0 b", "tab\t x",
         "　x y　 z", "<|endoftext|> a <|endoftext|>b", "12 34,5.", "word, word.", "...", "ﬁ ǅ ſ", "Σας ΟΔΟΣ",
         "a b c", "\n", "x.\nOf the", "é áb", "a\x1cb \x1cc", "'s 't a's", "ÀÉ,", "ªº µ ŉ", "🙂 a🙂"]


def words_of(n, seed, kinds=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(kinds)) for _ in range(n))


@pytest.mark.parametrize("load, name", [(tokens.byte_level, "byte_bpe_50k.json"), (tokens.word_level, "word_bpe_49k.json")])
def test_cached_ids_equal_the_tokenizer(load, name):
    ours, plain = load(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in [*EDGES, " ".join(EDGES), "\n".join(EDGES), words_of(500, 1)]:
        assert np.frombuffer(ours.encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_tournament_tree_finds_the_first_bin():
    r = random.Random(3)
    lengths = np.array([r.randrange(1, 101) for _ in range(300)])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free, expect = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            free.append(100)
            b = len(free) - 1
        expect[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert {i: (bins[i], offsets[i]) for i in range(300)} == expect


def test_packing_places_every_id_once(spark, documents):
    texts = [(1, None), (2, ""), (3, words_of(3000, 4)), (3, words_of(3000, 4)), (None, words_of(700, 5)), (4, words_of(1, 6))]
    texts += [(10 + i, words_of(40 + i, i)) for i in range(60)]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.token_pieces(documents(texts), queries._byte_bpe)
    rows = packing.sequences(pieces, packing.place(pieces, group_rows=16)).collect()
    held, got = defaultdict(list), Counter()
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.start, bytes(r.ids)] += 1
    expect = Counter()
    for doc, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            expect[doc, s, np.array(ids[s : s + 1024], "<u4").tobytes()] += 1
    assert got == expect
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.place(packing.token_pieces(documents([]), queries._byte_bpe)).count() == 0
    assert [packing.padded_length(n) for n in (512, 513, 1024)] == [512, 1024, 1024]


def test_id_files_round_trip(spark, documents):
    texts = [(5, words_of(4000, 1)), (2, None), (3, ""), (None, words_of(9, 2)), (2, words_of(30, 3)), (1, words_of(100, 4)), (1, words_of(100, 4))]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = rans.scratch(spark)
    rans.write_ids(documents(texts), queries._word_bpe, 2, path)
    rows = rans.with_starts(rans.read_ids(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 2, 3, 5]
    expect = sorted([(-1 if d is None else d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in texts])
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == expect
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    empty = rans.scratch(spark)
    rans.write_ids(documents([]), queries._word_bpe, 2, empty)
    assert rans.read_ids(spark, empty).count() == 0


def test_blocks_decode_alone_and_check_their_sums(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 5000)
    r = np.random.default_rng(1)
    ids = [(r.zipf(1.3, n) % 49000).astype("<u2").tobytes() for n in (1, 7000, 12000, 3)]
    data = rans.write_segment(4, 2, [7, None, 9, 10], ids)
    header, docs, lengths, flat = rans.read_segment(data + b"\n")
    assert (header["part"], header["segment"], docs, len(header["blocks"])) == (4, 2, [7, None, 9, 10], 4)
    assert flat.tobytes() == b"".join(ids) and lengths.tolist() == [1, 7000, 12000, 3]
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        rans.read_segment(bytes(broken))


def test_gear_hash_and_cuts_match_a_byte_loop():
    data = words_of(900, 8).encode()
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(cdc._GEAR[b])) & 0xFFFFFFFF
        if (h >> (32 - cdc.BITS) == 0 and i + 1 - last >= cdc.SMALLEST) or i + 1 - last == cdc.LARGEST:
            last = i + 1
            ends.append(last)
    if last < len(data):
        ends.append(len(data))
    assert cdc.chunk_ends(data) == ends


def test_chunks_stay_once(spark, documents):
    shared = words_of(80, 1)
    texts = [(4, words_of(50, 2) + " " + shared), (2, shared), (9, words_of(50, 3) + shared), (1, words_of(60, 4)), (7, None),
             (None, shared), (3, ""), (9, words_of(50, 3) + shared)]
    first = {}
    for doc, text in sorted(texts, key=lambda t: t[0] is None or t[0]) and sorted(texts, key=lambda t: (t[0] is None, t[0] or 0)):
        data, last = (text or "").encode(), 0
        for e in cdc.chunk_ends(data):
            first.setdefault(data[last:e], (doc, last))
            last = e
    expect = Counter()
    for doc, text in texts:
        data, last, kept = (text or "").encode(), 0, b""
        for e in cdc.chunk_ends(data):
            if e - last < cdc.SMALLEST or first[data[last:e]] == (doc, last):
                kept += data[last:e]
            last = e
        expect[doc, len(data), len(data) - len(kept), kept] += 1
    rows = cdc.dedup_chunks(documents(texts)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == expect
    assert any(r.n_removed > 200 for r in rows)
    assert cdc.dedup_chunks(documents([])).count() == 0


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_runs.C.UPPER, line_runs.C.LOWER))


def test_lines_in_many_documents_go(spark, documents):
    texts = [(i, f"own line {i}\n  Common LINE\t\nÀ\n\nown line {i}") for i in range(6)] + [(6, None), (7, ""), (None, "common line"), (8, "à\nx")]
    texts += [(8, "à\nx")]
    held = Counter(k for _, t in texts for k in {_key(x) for x in (t or "").split("\n")} if k)
    expect = Counter()
    for doc, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[_key(x)] < 4]
        expect[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    out = line_runs.drop_frequent_lines(documents(texts), min_docs=4, batches=5, fanout=2)
    assert Counter((r._doc.doc_id, r._n_lines, r._n_dropped, r._doc.text) for r in out.collect()) == expect
    assert out.select("_doc.*").columns == documents([]).columns and {r._doc["_lost"] for r in out.collect()} == {"_lost"}
    assert line_runs.drop_frequent_lines(documents([])).count() == 0


def test_the_query_builds_and_compacts_levels(spark, documents, tmp_path, monkeypatch):
    seen, real = [], line_runs.LineRuns.close

    def close(self):
        seen.append([len(level) for level in self.levels])
        real(self)
        assert not self._paths  # no run's files stay

    monkeypatch.setattr(line_runs.LineRuns, "close", close)
    documents([(i, f"common\nown {i}") for i in range(40)]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_line_dedup(spark, str(tmp_path))
    assert {(r.n_lines, r.n_dropped) for r in out.collect()} == {(2, 1)}
    assert seen == [[line_runs.BATCHES - line_runs.FANOUT, 1]]


def test_very_long_texts_lose_their_lines_too(spark, documents):
    long = "\n".join(["x", *(f"line {i}" for i in range(100_000)), "X "])
    out = line_runs.drop_frequent_lines(documents([(1, long), (2, "x\ny"), (3, "z\n x")]), min_docs=3)
    got = {r._doc.doc_id: (r._n_lines, r._n_dropped, len(r._doc.text)) for r in out.collect()}
    assert got == {1: (100_002, 2, len(long) - 5), 2: (2, 1, 1), 3: (2, 1, 1)}


def test_unseen_lines_of_a_batch(spark):
    runs = line_runs.LineRuns(spark, min_docs=2, fanout=2, buckets=4)
    for batch in ([1, 2], [2, 3], [3, 4], [4]):
        runs.add(spark.createDataFrame([(x, x) for x in batch], "_h1 long, _h2 long"))
    new = runs.unseen(spark.createDataFrame([(x, x) for x in (1, 4, 5, 6)], "_h1 long, _h2 long"))
    assert {r._h1 for r in new.collect()} == {5, 6}
    assert {r._h1 for r in runs.frequent().collect()} == {2, 3, 4}
    assert len(runs.runs()) < 4
    runs.close()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall((text or "").translate(str.maketrans(line_runs.C.UPPER, line_runs.C.LOWER)))


@pytest.mark.parametrize("block_words", [2_000_000, 25])
def test_every_shared_window_is_found(spark, documents, block_words):
    items = [(1, words_of(30, 1)), (2, words_of(10, 2)), (3, "Three Short, words"), (4, None), (5, "!!"), (2, words_of(12, 5)), (10, words_of(30, 1)),
             (None, words_of(15, 9)), (6, "a a a a a a a a a a a a")]
    i1, i2, i9 = items[0][1], items[1][1], items[7][1]
    texts = [(1, words_of(40, 50) + " " + i1.upper() + "; " + words_of(9, 51)), (2, i2), (3, i2[:-3]), (4, None), (5, ""),
             (6, " ".join(i1.split()[5:15]) + " x " + " ".join(i1.split()[4:13])), (7, "x three\nshort\twords y"), (8, i9),
             (9, "a " * 300), (None, i1 + i1), (1, words_of(20, 77))]
    expect = Counter()
    for doc, text in texts:
        w, hit, found = _words(text), set(), set()
        for item, t in items:
            v = _words(t)
            n = min(10, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        expect[doc, len(w), len(hit), tuple(sorted(found))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.hits(documents(texts), bench, block_words=block_words)
    rows = out.withColumn("n_hit", decontaminate.n_hit("_spans")).collect()
    assert Counter((r.doc_id, r._n_words, r.n_hit, tuple(r._items)) for r in rows) == expect
    assert decontaminate.hits(documents(texts), bench.limit(0)).where("size(_spans) > 0").count() == 0
    assert decontaminate.hits(documents([]), bench).count() == 0


def test_quality_measures_and_verdicts(spark, documents):
    body = [words_of(60, i) for i in range(8)]
    texts = [(i, "Shared line of five words\n" + body[i], "h") for i in range(6)]
    texts += [(20 + i, f"{words_of(5, 90 + i)}\n" + "\n".join([f"SHARED {j} " + words_of(30, 70 + j) for j in range(3)]), "h") for i in range(6)]
    texts += [(30, None, "h"), (31, "", None), (32, "a b c " * 30, "h"), (33, " \t\n x#$ \x0b x#$\n x#$ ", None), (34, "é ü\ne f", "g"),
              (None, body[7], None), (35, body[6] + "\n" + body[6], "g"), (35, body[6] + "\n" + body[6], "g")]
    texts += [(40 + i % 4, words_of(70, 40), "copies") for i in range(6)] + [(None, words_of(70, 40), "copies")]  # copies count
    texts += [(None, words_of(70, 41), "none") for _ in range(5)] + [(50, "Shared line of five words\n" + body[7], "h")]
    rows = quality_rules.assess(documents(texts), max_docs=3).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_removed_words, r.base_failed, r.kept) for r in rows)
    ws = re.compile(r"[^\x20\x09-\x0D]+")
    holders = defaultdict(dict)  # (host, line) -> the rows that hold it and their ids
    for row, (doc, t, host) in enumerate(texts):
        for line in (t or "").split("\n"):
            if ws.search(line):
                holders[host, _key(line)][row] = doc
    expect = Counter()
    for doc, t, host in texts:
        t = t or ""
        w = ws.findall(t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        lines = [x for x in t.split("\n") if ws.search(x)]
        gone = 0
        for x in lines:
            h = holders[host, _key(x)]
            if len(h) > 3 and doc != min((i for i in h.values() if i is not None), default=None):
                gone += len(ws.findall(x))
        failed = len(w) < 50 or 2 * len(covered) > len(w)
        expect[doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), gone, failed,
               not failed and len(w) - gone >= 0.3 * len(w)] += 1
    assert got == expect
    assert any(r.n_removed_words > 90 and not r.kept for r in rows) and any(r.doc_id == 20 for r in rows)
    assert sorted((r.doc_id or 0, r.kept) for r in rows if r.doc_id in (40, 41, 42, 43)) == [
        (40, True), (40, True), (41, False), (41, False), (42, False), (43, False)]
    kept = quality_rules.keep(documents(texts), max_docs=3)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality_rules.assess(documents([])).count() == 0


def test_lines_above_the_limits_go_from_kept_texts(spark, documents):
    texts = [(i, f" Shared LINE\n{words_of(60, i)}\n\nshared line\nonly here {i}", "h") for i in range(6)]
    texts += [(2, texts[2][1], "h"), (20, "shared line\n" + words_of(60, 20), "g"), (21, words_of(60, 21), "h"), (22, "shared line", "h"), (23, None, "h")]
    expect = Counter((i, t if h == "g" or i == 0 else "\n".join(x for x in t.split("\n") if _key(x) != "shared line"))
                     for i, t, h in texts if t and len(t) > 20)
    out = quality_rules.keep(documents(texts), max_docs=3)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == expect
    assert out.columns == documents([]).columns and out.where("_lost <> '_lost' OR _lines <> '_lines'").count() == 0
    assert sum("hared" not in t for _, t in expect.elements()) >= 5


def test_verdicts_do_not_follow_the_size_of_the_host(spark, documents):
    shared = "\n".join(f"shared {j} " + words_of(12, 200 + j) for j in range(5))
    few = [(i, shared + f"\nown {i}", "h") for i in range(30)]
    more = [(1000 + i, words_of(60, 1000 + i), "h") for i in range(600)]
    kept = lambda rows: sorted(r.doc_id for r in quality_rules.keep(documents(rows)).collect() if r.doc_id < 1000)
    assert kept(few) == kept(few + more) == [0]
    copies = [(i, words_of(80, 300), "h") for i in range(30)]
    assert kept(copies) == kept(copies + more) == [0]
    assert kept(copies[:20]) == list(range(20))  # at the limit, not above it


def test_a_very_long_text_is_judged_whole(spark, documents):
    long = "\n".join(words_of(9, i, kinds=10**6) for i in range(60_000)) + "\nat the very end"
    rows = [(1, long, "h"), (2, "at the very end\n" + words_of(60, 2), "h"), (3, "At the very END \n" + words_of(60, 3), "h")]
    got = {r.doc_id: (r.n_words, r.n_removed_words, r.kept) for r in quality_rules.assess(documents(rows), max_docs=2).collect()}
    assert got == {1: (540_004, 0, True), 2: (64, 4, True), 3: (64, 4, True)}


def test_pipeline_writes_the_texts_without_common_lines(spark, documents):
    import corpus_pipeline

    docs = documents([(i, f"shared line\n{words_of(60, i)}", "h") for i in range(22)])
    rows = corpus_pipeline.quality(spark, docs, "").collect()
    assert len(rows) == 22 and sum("shared line" in r.text for r in rows) == 1 and all(r.n_chars == len(r.text) for r in rows)
