"""Block labeller, archive converter, Jaccard join, prefix-free parsing and the pipeline against plain Python."""

import hashlib
import html
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import block_lstm, chosen_path, legacy_archive, prefix_free
from ledgerlens.llm.components import connected

from .test_small_operators import _words, words_of


# -- block labeller

def test_leaf_blocks():
    page = block_lstm.blocks('<!DOCTYPE html><title>T</title><p>a<b>b</b>&amp;\n c<br>d<p>e<ul><li>f<li><a href=x>g</a></ul><script>"</p>"</script>'
                             '<!-- <p>no</p> --><div class="Side-Bar x1" id=q>h<td>i</div>tail &copy;<style>p{}</style>')
    assert page.texts == ["ab& c d", "e", "f", "g", "h", "i", "tail ©"]
    assert page.links[3] == 1.0 and page.paths[4] == (("div", ("side", "bar", "x", "1", "q")),)
    assert block_lstm.blocks("").texts == [] and block_lstm.blocks(" plain\n text ").texts == ["plain text"]
    assert block_lstm.blocks("<div><script>never ends").texts == []


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){a()}</script>", "<script>if(a<b)x='</p>'</script >", "<script><!-- a<b</script>",
                                 "<SCRIPT>document.write('<p title=\"')</Script\n>", "<style>/* <!-- <x */</style>", "<svg><!-- </svg> --><text>i<n</text></svg>",
                                 "<template><!-- open <p>no</template>", "<script>s='</scripts>'+(i<n)</script x='>"])
def test_text_behind_raw_elements_stays(raw):
    page = block_lstm.blocks(f"<div>menu</div>{raw}<article><p>first<p>second</article><script>track(1)</script><p>last")
    assert page.texts == ["menu", "first", "second", "last"]
    assert block_lstm.blocks(f"a{raw}b").texts == ["a", "b"]


def test_gradients_match_differences(monkeypatch):
    r = random.Random(1)
    pages = [block_lstm.blocks(block_lstm.layout(r, [words_of(30, 1)])) for _ in range(3)]
    labels = [block_lstm.labels_of(p) for p in pages]
    model = {k: v.astype(np.float64) + 0.05 * np.random.default_rng(2).normal(size=v.shape) for k, v in block_lstm.new_model(3).items()}
    model = {k: v.astype(np.float32) for k, v in model.items()}

    def loss_and_grads():
        batch = block_lstm.Batch(pages, model["path"], model["word"])
        return block_lstm.gradients(model, batch, np.concatenate([labels[k] for k in batch.order]))

    _, grads = loss_and_grads()
    for k in model:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        was, step = model[k][at], np.float32(1e-2)
        model[k][at] = was + step
        up = loss_and_grads()[0]
        model[k][at] = was - step
        down = loss_and_grads()[0]
        model[k][at] = was
        assert (up - down) / (2 * step) == pytest.approx(grads[k][at], rel=0.08, abs=1e-5)


def _article_page(r, i):
    body = [words_of(r.randint(2, 40), r.random()) for _ in range(r.randint(1, 8))]
    title = words_of(4, r.random())
    parts = "".join(f"<p>{html.escape(b)} &amp; x</p>" for b in body)
    menu = "".join(f"<li><a href=/a>{words_of(2, r.random())}</a></li>" for _ in range(4))
    page = (f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{words_of(20, r.random())}</div>"
            f"<article><h1>{title}</h1>{parts}</article><section class=comments><p>{words_of(30, r.random())}</p></section>"
            f"<aside class=sidebar>{words_of(9, r.random())}</aside><footer>&copy; {words_of(3, r.random())}</footer></body></html>")
    return page, "\n".join([title, *(b + " & x" for b in body)])


def test_articles_of_held_out_pages(spark):
    r = random.Random(5)
    made = [_article_page(r, i) for i in range(60)]
    rows = [(i, f"u{i}", p, "x") for i, (p, _) in enumerate(made)] + [(100, None, None, "x"), (None, "u", "", "x"), (101, "v", made[0][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in block_lstm.extract(pages, sample_pages=20).collect()}
    right = sum(got[i] == t for i, (_, t) in enumerate(made))
    assert right >= 59 and got[100] == "" and got[None] == "" and got[101] == got[0]
    assert block_lstm.extract(pages.limit(0)).count() == 0


def test_held_out_layouts():
    r, pool = random.Random(8), [words_of(60, i) for i in range(20)]
    model = block_lstm.train([_article_page(r, i)[0] for i in range(10)], pages=500)
    wrong = total = 0
    for _ in range(100):
        page = block_lstm.blocks(block_lstm.layout(r, pool))
        y = block_lstm.labels_of(page)
        if page.texts:
            batch = block_lstm.Batch([page], model["path"], model["word"])
            wrong += int(((batch.split(block_lstm.scores(model, batch))[0] > 0.5) != (y > 0)).sum())
            total += len(y)
    assert wrong < 0.02 * total


# -- archives

def test_a_very_long_page_among_small_ones_takes_memory_by_its_blocks():
    import tracemalloc

    r = random.Random(3)
    model = block_lstm.new_model(1)
    small = [block_lstm.blocks(block_lstm.layout(r, [])) for _ in range(500)]
    small = [p for p in small if p.texts]
    long = block_lstm.blocks("<html><body><ul>" + "".join(f"<li>item {i} of a list" for i in range(20_000)) + "</ul></body></html>")
    assert len(long.texts) == 20_000
    tracemalloc.start()
    batch = block_lstm.Batch([*small[:250], long, *small[250:]], model["path"], model["word"])
    together = batch.split(block_lstm.scores(model, batch))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200 << 20
    assert len(together[250]) == 20_000
    for k in (0, 100, 250, len(small)):  # each page scores as it does alone
        page = [*small[:250], long, *small[250:]][k]
        alone = block_lstm.Batch([page], model["path"], model["word"])
        assert np.abs(block_lstm.scores(model, alone) - together[k]).max() < 1e-5


def test_archives_round_trip(spark, monkeypatch):
    big, same = words_of(300, 1), "é" * 50
    rows = [(5, "http://a/ b\nc", same), (3, "http://b", same), (9, None, same), (4, "-", "short"), (6, "", "short"), (7, "u", None), (8, "v", ""),
            (2, "w", big + "\r\n\r\nWARC/1.0\r\n" + big), (None, "x", same), (3, "http://b", same), (11, "y", "é" * 49 + "e"), (10, "z", "é" * 49 + "e")]
    monkeypatch.setattr(legacy_archive, "ARCHIVE_BYTES", 300)
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type long").coalesce(2)
    arc, warc = legacy_archive.scratch(spark, "arc"), legacy_archive.scratch(spark, "warc")
    legacy_archive.write_arc(pages, arc)
    legacy_archive.convert(spark, arc, warc)
    got = legacy_archive.with_targets(legacy_archive.read_warc(spark, warc)).collect()
    first = {}
    for page, _, text in rows:
        if page is not None:
            first[text] = min(page, first.get(text, page))
    expect = Counter()
    for page, _, text in rows:
        data = (text or "").encode()
        again = len(data) >= 100 and page is not None and page > first[text]
        expect[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[text] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expect
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%20b%0Ac"} and [r.url for r in got if r.page_id == 9] == [None]
    assert all(r.block.endswith(b"\r\n\r\n") for r in got if r.record_type == "revisit")
    none = legacy_archive.scratch(spark, "arc")
    legacy_archive.write_arc(pages.limit(0), none)
    legacy_archive.convert(spark, none, f"{none}-warc")
    assert legacy_archive.read_warc(spark, f"{none}-warc").count() == 0


def test_both_versions_and_broken_archives():
    for version in ("1", "2"):
        data = legacy_archive.arc_start(version, "f.arc") + legacy_archive.arc_record(1, "http://a", b"x\ny", version, "f.arc", 99) + b"\n"
        (_, fields, http, _, payload), = legacy_archive.arc_records(data)
        assert (fields["URL"], http["x-page-id"], payload, fields.get("Result-code")) == ("http://a", "1", b"x\ny", "200" if version == "2" else None)
    for broken in (data[:-4], data.replace(b"filedesc", b"other"), data.replace(b"http://a", b"http://a b")):
        with pytest.raises(ValueError):
            list(legacy_archive.arc_records(broken))


# -- Jaccard join

def _shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (text or "").split()]
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def _linked(texts):
    """Per row: its class (smallest doc_id) and its number of links, by comparing all pairs."""
    sets, root, links = [_shingles(t) for _, t in texts], list(range(len(texts))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        ids[find(i)].append(doc)
    return [(min((d for d in ids[find(i)] if d is not None), default=None), links[i]) for i in range(len(texts))]


def _edited(text, r, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def _near_copies():
    r = random.Random(11)
    base = [words_of(120, i) for i in range(12)]
    texts = [(100 + i, _edited(base[i % 6], r, r.randrange(5))) for i in range(90)]
    texts += [(300 + i, _edited(base[7], r, 1)) for i in range(150)]  # a group larger than a leaf
    texts += [(500 + i, words_of(30, 900 + i) + " " + base[8]) for i in range(80)]  # a shared passage, similar at about 0.66
    texts += [(1, "Two Words"), (2, "two\twords\n"), (3, None), (4, ""), (5, " \n"), (None, base[9]), (6, base[9].upper()), (6, base[9].upper()), (None, "lonely")]
    return texts


@pytest.mark.parametrize("leaf", [1024, 40])
def test_every_link_and_class(spark, documents, monkeypatch, leaf):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    texts = _near_copies()
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.classes(documents(texts)).collect())
    expect = Counter((doc, c, n) for (doc, _), (c, n) in zip(texts, _linked(texts), strict=True))
    assert got == expect
    assert chosen_path.classes(documents([])).count() == 0
    assert chosen_path.classes(documents([(1, None)])).collect() == [(1, 1, 0)]


def test_groups_are_dealt_into_tiles(spark, documents, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE_SETS", 20)
    texts = _near_copies()[90:250]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.classes(documents(texts)).collect())
    assert got == Counter((doc, c, n) for (doc, _), (c, n) in zip(texts, _linked(texts), strict=True))


def test_empty_tiles_count_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE_BYTES", 1000)
    r, base = random.Random(3), words_of(400, 1)
    texts = [(i, _edited(base, r, 4)) for i in range(3)]  # 3 sets in about 10 tiles
    got = Counter((x.doc_id, x.class_id, x.n_links) for x in chosen_path.classes(documents(texts)).collect())
    assert got == Counter({(i, 0, 2): 1 for i in range(3)})


def test_one_of_each_class_stays(spark, documents):
    texts = _near_copies()
    out = chosen_path.keep_one(documents(texts))
    kept = Counter(r.doc_id for r in out.collect())
    classes = {(c, doc if not _shingles(t) else None) for (doc, t), (c, _) in zip(texts, _linked(texts), strict=True)}
    assert sum(kept.values()) == len(classes) and kept[6] == 1 and kept[3] == kept[4] == kept[5] == 1
    assert out.columns == documents([]).columns


def test_one_of_equal_texts_without_words_stays(spark, documents):
    texts = [(9, ""), (7, ""), (None, ""), (8, " "), (7, ""), (3, None), (2, None), (5, "some words")]
    out = chosen_path.keep_one(documents(texts))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(7, ""), (8, " "), (2, None), (5, "some words")])
    assert out.columns == documents([]).columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}


def test_runs_follow_the_recall():
    assert chosen_path.runs_needed(0.9) < chosen_path.runs_needed(0.99) < chosen_path.runs_needed(0.9999) == 15


def test_deep_buckets_get_the_runs_they_need(spark, monkeypatch):
    r, rows, runs, depths = np.random.default_rng(4), [], [], []
    family = r.integers(0, 1 << 30, 64)
    for i in range(400):  # mutual similarity about 0.36, so that small leaves need many levels; every second one has a near copy
        one = np.where(r.random(64) < 0.6, family, r.integers(0, 1 << 30, 64))
        rows += [(2 * i, one.tolist()), (2 * i + 1, np.where(r.random(64) < 0.8, one, r.integers(0, 1 << 30, 64)).tolist())]
    roots, split = chosen_path._roots, chosen_path._split
    monkeypatch.setattr(chosen_path, "_roots", lambda sets, first, last, seed: runs.append((first, last)) or roots(sets, first, last, seed))
    monkeypatch.setattr(chosen_path, "_split", lambda *a: depths.append(split(*a)) or depths[-1])
    sets = spark.createDataFrame(rows, "id long, _sketch array<int>")
    assert chosen_path.candidate_links(sets, leaf=20).count() > 0
    deepest = max(map(len, depths)) + 2
    assert deepest >= 5 and runs[0] == (0, 15) and runs[-1][1] >= chosen_path.runs_needed(chosen_path.RECALL, deepest)
    assert all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))


# -- prefix-free parsing

def _removed(texts, span=50):
    first = {}
    for doc, t in texts:
        data = (t or "").encode()
        for i in range(len(data) - span + 1):
            key = data[i : i + span]
            first[key] = min(first.get(key, 1 << 62), doc if doc is not None else 1 << 62)
    out = Counter()
    for doc, t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if first[data[i : i + span]] < (doc if doc is not None else 1 << 62):
                gone[i : i + span] = b"\1" * span
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc, len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g)] += 1
    return out


@pytest.mark.parametrize("segment", [4 << 20, 700, 100])
def test_repeated_bytes_go(spark, documents, segment):
    r, passage = random.Random(2), words_of(60, 1)
    texts = [(i, words_of(r.randint(5, 60), 100 + i) + passage[r.randrange(80) : r.randrange(100, 300)] + words_of(9, 200 + i)) for i in range(25)]
    texts += [(50, "a" * 120), (51, "a" * 49), (52, "b" + "a" * 60 + "\0\0" + "a" * 50), (53, "ab" * 60), (54, "ba" * 40), (55, "é" * 60), (56, "xé" + "é" * 25)]
    texts += [(60, None), (61, ""), (None, passage), (None, passage), (62, passage), (62, passage), (40, passage[30:79]), (41, passage[30:80]), (42, passage[30:81])]
    texts += [(70 + i, "z" * i + passage[100:180]) for i in range(6)]
    rows = prefix_free.dedup_substrings(documents(texts), segment=segment).collect()
    got = Counter((x.doc_id, x.n_bytes, sum(s.last - s.first for s in x.spans), len(x.spans), bytes(x.kept)) for x in rows)
    assert got == _removed(texts)
    assert prefix_free.dedup_substrings(documents([])).count() == 0


def test_a_window_has_one_trigger_in_segments_of_any_size(monkeypatch):
    """Also where hashes differ in their lowest bits only."""
    r = np.random.default_rng(5)
    window = r.integers(0, 256, 50).astype(np.uint8)
    real = prefix_free.C.range_hashes
    for mask in ((1 << 64) - 1, 0xFFFF, 3):
        monkeypatch.setattr(prefix_free.C, "range_hashes", lambda *a, m=mask: real(*a) & np.uint64(m))
        places = set()
        for size in (50, 100, 5_000, 4 << 20):
            data = r.integers(0, 256, size).astype(np.uint8)
            at = size // 2 if size > 100 else size - 50
            data[at : at + 50] = window
            p = prefix_free.parse(data, np.array([0]), np.array([size]))
            k = int(np.searchsorted(p.first, at, side="right")) - 1
            assert p.first[k] <= at <= p.last[k]
            places.add(int(p.at[k]) - at)
        assert len(places) == 1


def test_a_text_of_many_segments_is_cut_whole(spark, documents):
    r = np.random.default_rng(1)
    long = r.integers(97, 123, 9 << 20).astype(np.uint8).tobytes().decode()
    texts = [(1, long[4_194_200:4_194_400] + "x"), (2, long), (2, long), (3, long[:5_000_000]), (4, "y" + long[8_388_500:8_388_700]), (5, None)]
    got = {(x.doc_id, x.n_bytes, len(x.kept), tuple((s.first, s.last) for s in x.spans)) for x in prefix_free.dedup_substrings(documents(texts)).collect()}
    cut = ((4_194_200, 4_194_400),)
    assert got == {(1, 201, 201, ()), (2, len(long), len(long) - 200, cut), (3, 5_000_000, 0, ((0, 5_000_000),)), (4, 201, 1, ((1, 201),)), (5, 0, 0, ())}


def test_suffix_order_is_lexicographic():
    data = np.frombuffer(b"banana\0banana\xff" + words_of(30, 1).encode(), np.uint8)
    starts = np.arange(len(data) - 12)
    order, new = prefix_free.suffix_order(data, starts, span=12)
    strings = [data[s : s + 12].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings)
    assert new.tolist() == [i == 0 or strings[order[i]] != strings[order[i - 1]] for i in range(len(order))]


@pytest.mark.parametrize("span,gram", [(50, 20), (12, 5)])
def test_a_parse_in_blocks_is_the_parse_of_the_whole(span, gram):
    r = random.Random(4)
    texts = [words_of(r.randint(0, 90), 700 + i).encode() for i in range(30)] + [b"", b"a" * 700, b"ab" * 300, b"x" * span, b"y" * (span - 1)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
    starts = ends - [len(x) for x in texts]
    whole = prefix_free.parse(data, starts, ends, span, gram, block=1 << 20)
    assert len(whole.first) > 100 and (whole.last - whole.first <= span - gram).all()
    for block in (64, 65, 100, 1000):
        part = prefix_free.parse(data, starts, ends, span, gram, block=block)
        assert all(np.array_equal(getattr(part, k), v) for k, v in vars(whole).items())


def _held(f, *args) -> int:
    """MB that a call holds at most."""
    tracemalloc.start()
    f(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most >> 20


def test_a_segment_and_a_large_bucket_take_little_memory():
    """op8 ran out of executor memory at 6 GB: hashes of a whole segment and windows of a whole bucket were held at once."""
    data = np.random.default_rng(3).integers(97, 123, 4 << 20).astype(np.uint8)
    assert _held(prefix_free.parse, data, np.arange(0, 4 << 20, 1 << 14), np.arange(1 << 14, (4 << 20) + 1, 1 << 14)) < 80
    n, at = 400_000, 4
    names, orders, sizes = np.arange(n, dtype="<u8"), np.arange(n, dtype="<i8"), np.full(n, 60, "<u2")
    raw = np.resize(data, 60 * n)
    payload = [np.uint32(n).tobytes(), names.tobytes(), orders.tobytes(), sizes.tobytes()]
    payload += [bytes(n), raw.tobytes()]
    batch = prefix_free._rows([0], [0], [b"".join(payload)])
    assert _held(lambda: list(prefix_free._shared_windows(iter([batch])))) < 300


def test_windows_sorted_in_parts_are_the_same():
    r = np.random.default_rng(8)
    size = r.integers(50, 81, 300)
    data = r.integers(97, 99, int(size.sum())).astype(np.uint8)
    data[1000:9000] = np.tile(data[:400], 20)
    order = r.integers(0, 60, 300)
    bits, first, begin = [], {}, np.cumsum(size) - size
    windows = [(k, i, data[begin[k] + i : begin[k] + i + 50].tobytes()) for k in range(300) for i in range(size[k] - 49)]
    for k, _, w in windows:
        first[w] = min(first.get(w, 99), order[k])
    bits = [sum(1 << i for j, i, w in windows if j == k and first[w] < order[k]) for k in range(300)]
    assert any(bits)
    for most in (1 << 20, 500, 7):
        assert prefix_free.shared(data, size, order, most).tolist() == bits


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_phrases_of_a_common_line_are_dealt_by_what_surrounds_it(spark, documents, hot):
    r = random.Random(6)
    line, passage = "A line that stands in every document of this corpus, and its neighbours differ.", words_of(30, 2)
    near = [words_of(3, 900 + i) for i in range(4)]
    texts = [(i, f"{words_of(r.randint(1, 12), 300 + i)} {r.choice(near)}\n{line}\n{r.choice(near)} {words_of(9, 400 + i)}{passage[r.randrange(60):]}") for i in range(40)]
    texts += [(40 + i, "z" * i + line[: 50 + i]) for i in range(25)] + [(None, line), (None, line[9:]), (3, line[11:70])]
    rows = prefix_free.dedup_substrings(documents(texts), segment=600, hot=hot).collect()
    got = Counter((x.doc_id, x.n_bytes, sum(s.last - s.first for s in x.spans), len(x.spans), bytes(x.kept)) for x in rows)
    assert got == _removed(texts)


def test_a_task_holds_one_bucket(spark, documents):
    """Hashed bucket numbers put up to six buckets in one task and none in others."""
    texts = [(i, words_of(400, 50 + i % 9)) for i in range(60)]
    seen = []
    real = prefix_free.C.saved
    try:
        prefix_free.C.saved = lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label)
        prefix_free.dedup_substrings(documents(texts), buckets=16, segment=9000).count()
    finally:
        prefix_free.C.saved = real
    assert len(seen) == 2 and not any("hashpartitioning(bucket" in x for x in seen)


# -- pipeline

def test_pipeline_stages(spark, tmp_path, documents):
    leak, boiler = words_of(25, 500), "Common boilerplate line of this corpus"
    good = [(i, words_of(80, i) + f"\n{boiler}\n" + words_of(20, 50 + i), f"s{i % 3}") for i in range(12)]
    texts = good + [(20, good[0][1].replace(" ", " inserted ", 1), "s0"), (21, words_of(70, 77) + " " + leak, "s1"), (22, "too short", "s1"),
                    (23, None, "s2"), (24, "rep eat " * 60, "s2"), (1, good[1][1], "s1")]
    path = str(tmp_path)
    documents(texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.C.saved(stage(spark, docs, path), "t")
        assert out.columns == docs.columns and out.where("_digest <> '_digest' OR _spans <> '_spans' OR id <> 'id'").count() == 0
        seen.append((name, sorted(x.doc_id for x in out.collect())))
        docs = out
    assert seen[0][1] == sorted([*range(12), 1, 20, 21])
    assert seen[1][1] == seen[0][1] and docs.where("text LIKE '%boilerplate%'").count() == 0
    assert seen[2][1] == [*range(12), 21] and seen[3][1] == list(range(12))
    pieces = corpus_pipeline.run(spark, path).collect()
    assert sorted({p.doc_id for p in pieces}) == list(range(12))
    assert all(sum(p.length for p in pieces if p.doc_id == d) == next(p.doc_tokens for p in pieces if p.doc_id == d) for d in range(12))
    assert all(len(_words(t[1])) > 50 for t in good)
