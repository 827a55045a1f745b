"""The methods against brute force, exact round trips and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import bpe, embed, html, langid, lines, minhash, packing, quality, queries, shared
from tickloom.llm.graph import connected_components, roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def encoded(texts):
    vocabulary, _, encoder = bpe.transducer_encoder(queries.tokenizer_path())
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    return vocabulary, [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_bpe_equals_the_library(library):
    rng = random.Random(1)
    signs = "abcdefghi  \n\t'''sstmdrellve0123.,!?-éèßñ中文字\u3000 \x85\x1c\u200b😀ǅª²½\r"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "it's we'll 'tis ''s", "a<|endoftext|>b", "x" * 3000, " " * 900 + "x", "".join(rng.choice("ab") for _ in range(2000)), "".join(rng.choice("aentrs") for _ in range(6000))]
    vocabulary, ids = encoded(texts)
    for text, own in zip(texts, ids, strict=True):
        assert own == library.encode(text or "", add_special_tokens=False).ids
        assert "".join(bpe.decode(vocabulary, np.array(own, np.int64), 7)) == library.decode(own, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    vocabulary, ids = encoded([text])
    assert "".join(bpe.decode(vocabulary, np.array(ids[0], np.int64), 3)) == text


def test_transducer_streams_with_a_bounded_window():
    transducer = bpe.transducer_encoder(queries.tokenizer_path())[1]
    data = "".join(random.Random(5).choice("theandingofre") for _ in range(20_000)).encode()
    parts = list(transducer.stream(data[i : i + 100] for i in range(0, len(data), 100)))
    assert len(parts) > 10 and [i for p in parts for i in p] == transducer.encode(data)
    assert transducer.encode(b"".join(transducer.v.bytes_of[i] for p in parts for i in p)) == [i for p in parts for i in p]


def test_utf8_machine_holds_back():
    machine = bpe.Utf8Machine()
    data = "aé中😀".encode()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.finish() == "aé中😀"
    assert machine.feed(b"\xe4\xb8") + machine.finish() == "\ufffd"


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 64) for _ in range(800)), reverse=True)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        able = [r for r in rooms if r >= n]
        if able:
            assert 64 - o == min(able)
            rooms[b] -= n
        else:
            assert b == len(rooms) and o == 0
            rooms.append(64 - n)
    assert len(rooms) == max(bins) + 1


def test_quality_counts_equal_plain_counts(spark):
    rng = random.Random(3)
    texts = ["", " \n", "a b c a b c", "x " * 500, "# $ |\n\n# $ |\nend"] + ["".join(rng.choice(["a", "bb", "c|", " ", "\n", "\t", "é"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    for r in quality.judge(rows).collect():
        words = WORD.findall(r.text)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        twice = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(3)}
        full = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(r.text.count(x) for x in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_fences_reject_outliers_of_a_group_only(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "abcdefgh", 80), "en", "s") for i in range(150)] + [(1000, " ".join("ab##" for _ in range(40)) + " " + prose(rng, "abcdefgh", 60), "en", "s")]
    rows += [(2000 + i, " ".join(f"{prose(rng, 'abcd', 1)}##" for _ in range(80)), "en", "code") for i in range(150)]
    out = {r.doc_id: r.quality.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert not out[1000] and sum(out[i] for i in range(150)) == 150 and sum(out[2000 + i] for i in range(150)) == 150


def test_language_codes_and_accuracy(spark):
    for k in (2, 3, 4, 5, 9):
        words = langid.code(k)
        assert len({tuple(w) for w in words}) == k
    rng, letters = random.Random(5), {"xa": "abcdefgh", "xb": "efghijkl", "xc": "mnopqrab", "xd": "stuvwxyz"}
    rows = [(i, prose(rng, letters[lang], rng.choice([4, 40])), lang) for i in range(800) for lang in [list(letters)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.predict(df, langid.fit(df)).filter(langid.held_out("doc_id")).collect()
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_features_do_not_depend_on_parts():
    texts = [None, "", "a", "Ärger ΣΑΣ 漢字 😀", "two words and more of them, " * 40]
    whole = langid.features(texts)
    for step in (1, 2, 3, 50):
        assert (langid.features(texts, step) == whole).all()
    assert whole[:2].sum() == 0 and np.allclose(np.linalg.norm(whole[2:], axis=1), 1)


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(6)
    line = lambda: prose(rng, "abcdefghij", 9).capitalize() + "."
    passage = "\n".join(line() for _ in range(12))
    own = [[line() for _ in range(6)] for _ in range(20)]
    texts = ["\n".join(o[:3]) + "\n" + (passage if i % 2 else line()) + "\n" + "\n".join(o[3:]) for i, o in enumerate(own)]
    out = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert out[1].text == texts[1] and all(out[i].text == texts[i] for i in range(0, 20, 2))
    for i in range(3, 20, 2):
        assert len(out[i].text) < len(texts[i]) - 0.5 * len(passage)
        assert all(x in out[i].text for x in own[i][:2] + own[i][4:])
    twin = lines.dedup(spark.createDataFrame([(1, "é" * 30 + ". " + "ü" * 30 + ".\n" + "x" * 50)] * 2, "doc_id bigint, text string")).collect()
    assert twin[0].text == twin[1].text and twin[0].n_removed == 0


def test_all_whole_lines_of_a_passage_go(spark):
    rng = random.Random(8)
    line = lambda n=9: prose(rng, "abcdefghij", n).capitalize() + "."
    passages = ["\n".join([line(), *(line(rng.choice((1, 2, 9))) for _ in range(k))]) for k in (3, 4, 6, 9)] + [line() + "\n" + line()]
    rows = [(2 * i + j, line() + "\n" + p + "\n" + line()) for i, p in enumerate(passages) for j in (0, 1)]
    rows += [(90, "Same line again here, it is.\n" * 5), (91, line() + "\n" + passages[0])]
    out = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, p in enumerate(passages):
        first, again = rows[2 * i][1], rows[2 * i + 1][1]
        assert out[2 * i] == first and out[2 * i + 1] == again.replace(p + "\n", "")
    assert out[90] == "Same line again here, it is.\n" * 2 and out[91] == rows[-1][1].removesuffix(passages[0])


def test_chunks_do_not_depend_on_what_stands_before():
    rng = random.Random(7)
    body = "\n".join(prose(rng, "abcdefghij", 8) for _ in range(40)) + "\n"

    def hashes(text):
        points = shared.code_points(text)
        return set(lines.chunk_spans(points, np.array([0, len(points)]))[3].tolist())

    a, b = hashes("one line\n" + body), hashes("two\nother\nlines here\n" + body)
    assert len(a & b) >= 0.7 * len(a)


def test_probability_jaccard():
    a, b = np.array([1, 2, 3, 4], np.uint32), np.array([2, 3, 4, 5], np.uint32)
    assert minhash.probability_jaccard(a, np.ones(4), b, np.ones(4)) == pytest.approx(3 / 5)
    x, y = np.array([1.0, 3, 2, 5]), np.array([2.0, 1, 4, 1])
    keys = np.union1d(a, b)
    u = np.array([dict(zip(a, x, strict=True)).get(k, 0) for k in keys])
    v = np.array([dict(zip(b, y, strict=True)).get(k, 0) for k in keys])
    want = sum(1 / sum(max(u[j] / u[i], v[j] / v[i]) for j in range(len(keys))) for i in range(len(keys)) if u[i] and v[i])
    assert minhash.probability_jaccard(a, x, b, y) == pytest.approx(want)
    assert minhash.probability_jaccard(a, x, a, 3 * x) == pytest.approx(1)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(8)
    shares = []
    for _ in range(40):
        h = np.unique(rng.integers(1, 2**63, 400, dtype=np.uint64))
        sides = h[:320], h[80:]
        text = np.repeat([0, 1], [len(s) for s in sides])
        sig = minhash.signatures(text, np.concatenate(sides), np.ones(len(text)), 2)
        assert (sig != 0).all()
        shares.append((sig[0] == sig[1]).mean())
    assert np.mean(shares) == pytest.approx(240 / 400, abs=0.02)


def sets_of(text):
    w = WORD.findall(text)
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(9), []
    for _ in range(25):
        words = prose(rng, "abcdefghij", rng.randint(40, 160)).split()
        for _ in range(rng.randint(1, 12)):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = "changed" + str(rng.randint(0, 99))
            texts.append(" ".join(own))
    texts += ["a b", "a b", "a c", "", "..."]
    sets, up = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    out = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert {i: out[i].class_id for i in out} == {i: find(i) for i in range(len(texts))}
    assert all(out[i].kept == (out[i].class_id == i) for i in out)


def _prose(seed, n):
    return " ".join(f"{seed}w{k}" for k in range(n))


def test_wrapper_marks_slots_repeats_and_options():
    page = lambda items, body, ad: f"<body><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>{'<i>note</i>' if ad else ''}<div class=x><p>{body}</p></div><p>fixed</p></body>"
    pattern, path = html.infer([page("ab", _prose("a", 9), True), page("abc", _prose("b", 9), False), page("a", _prose("c", 9), False)])
    assert "li(_)" in pattern or "li(*)" in pattern
    assert "+" in pattern and "i(_)?" in pattern and "p(_)" in pattern and path[:2] == ["body", "div.x"]
    assert html.extract(page("abc", "fourth text", True), path) == "fourth text"


def test_wrappers_decide_before_markup(spark):
    story = lambda i: f"<p>story {i} begins {_prose(i, 30)}</p><p>and {i} goes on</p>"
    page = lambda i: f"<body><div class=top><article class=card><p>Teaser</p></article><article class=card><p>Other teaser</p></article></div><article class=full><h1>Title {i}</h1>{story(i)}<div class=x1>Printed by the house</div></article></body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(1, 9)] + [(20, "http://single.org/", page(20))]
    texts = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(1, 9):
        assert texts[i] == f"Title {i}\n\nstory {i} begins {_prose(i, 30)}\n\nand {i} goes on"
    assert texts[20] == f"Title 20\n\nstory 20 begins {_prose(20, 30)}\n\nand 20 goes on\n\nPrinted by the house"  # markup alone decides


def test_wrappers_grow_over_all_distinct_pages(spark):
    page = lambda i, rare: f"<body><div class=a><div>House text</div><h2>Summary</h2><p>story {i} {_prose(i, 30)}</p>{'<div>Only on few pages</div>' if rare else ''}</div></body>"
    pages = [page(i, i > 36) for i in range(1, 41)]
    rows = [(i, f"http://a.org/{i}", p) for i, p in enumerate(pages)] + [(100 * k + i, f"http://copies{i}.org/{k}", pages[i]) for i in range(8) for k in range(1, 13)] + [(5000 + i, f"http://copies{i}.org/x", pages[i + 9]) for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    texts = {r.page_id: r.text for r in html.main_text(frame).collect()}
    want = [f"Summary\n\nstory {i} {_prose(i, 30)}" for i in range(1, 41)]
    assert [texts[i] for i in range(40)] == want  # headings stay; no text of four rare pages
    for i in range(8):  # twelve copies of a page are one page, and two pages prove no template
        assert texts[100 + i] == "House text\n\n" + want[i] and texts[5000 + i] == "House text\n\n" + want[i + 9]


def test_near_equal_pages_keep_their_story(spark):
    page = lambda day: f"<body><div class=m><div class=d>{day} May</div><h1>The title</h1><div class=s><p>{_prose('s', 80)}</p><p>End.</p></div></div></body>"
    other = f"<body><div class=m><div class=d>9 June</div><h1>Another</h1><div class=s><p>{_prose('o', 80)}</p><p>Stop.</p></div></div></body>"
    rows = [(i, "http://a.org/x", page(i)) for i in (1, 2)] + [(10 + i, "http://b.org/x", page(i)) for i in range(6)] + [(20, "http://b.org/y", other), (30, "http://alone.org/", page(1))]
    texts = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    want = lambda day: f"{day} May\n\nThe title\n\n{_prose('s', 80)}\n\nEnd."
    assert all(texts[i] == want(i) for i in (1, 2)) and all(texts[10 + i] == want(i) for i in range(6)) and texts[30] == want(1)
    assert texts[20] == f"9 June\n\nAnother\n\n{_prose('o', 80)}\n\nStop."


def _hosts(seed, hosts, pages):
    """Pages without any telling markup, and their main texts: menus, notes and legal text around a story whose layout varies."""
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join(f"{'abcdefgh'[x % 8]}{x}" for x in rng.integers(0, 5000, k))
    rows, want = [], {}
    for h in range(hosts):
        menu, legal, note = [word(2) for _ in range(6)], word(40), word(12)
        deep = ["<div class=k>" * k + "%s" + "</div>" * k for k in (0, 3, 90)][h % 3]
        for i in range(pages):
            sections = [("Summary" if k % 2 else word(2), word(int(rng.integers(5, 40)))) for k in range(int(rng.integers(1, 45)))]
            body = "".join(f"<h2>{t}</h2><p>{p}</p>" for t, p in sections)
            html_ = f"<body><div class=ra><ul>{''.join(f'<li>{m}</li>' for m in menu)}</ul></div>{f'<div class=rb>{note}</div>' if i % 2 else ''}" + deep % f"<div class=rc>{body}</div>" + f"<div class=rd><p>{legal}</p></div></body>"
            rows.append((h * 1000 + i, f"http://h{h}.org/{i}", html_))
            want[h * 1000 + i] = "\n\n".join(x for pair in sections for x in pair)
    return rows, want


def test_wrappers_find_what_markup_alone_does_not(spark):
    rows, want = _hosts(3, 6, 14)
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 3, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            texts = {r.page_id: r.text for r in html.main_text(frame.repartition(n)).collect()}
            assert texts == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(html.extract(page, []) == want[key] for key, _, page in rows) == 0


def test_class_names():
    for marks in ("ad", "ads-top", "comments", "post-comments", "cookie-notice", "share", "share-buttons", "related-posts", "social_media", "site-nav", "widget-3", "newsletter signup"):
        assert html.names_aside(marks), marks
    for marks in ("share-price", "story related", "side-effects", "hashtags-history", "article", "download", "shared", "notice-period"):
        assert not html.names_aside(marks), marks


def test_long_and_deep_pages():
    texts = [f"p{i}" for i in range(3000)]
    page = lambda seed: "<body>" + "<div>" * 3000 + "".join(f"<p>{t}{seed}</p><ul><li>x</ul>" for t in texts) + "</div>" * 3000
    wrapper = html.learn([page(1), page(2)])
    again = html.Group.unpacked(wrapper.packed())
    assert again.packed() == wrapper.packed()
    rules = html._rule_tree(html.rules_of(wrapper))
    assert html.extract(page(1), [], rules).split("\n\n")[:4] == ["p01", "x", "p11", "x"]
    assert html.extract("<div>" * 70 + "<p>one</p><p>two</p>", [], rules) == "one\n\ntwo"


def test_main_text_of_messy_pages():
    page = "<html><body><header>Site</header><div id=cookie-notice>c</div><article><h1>T &amp; t</h1><p>One<br>two&nbsp; three<p>Four <i>in</i>line<ul><li>a<li>b</ul><div class='ad'>ad</div><section class=comments><p>bad</p></section><form><input></form></article><aside>no</aside><footer>f</footer>"
    assert html.extract(page, []) == "T & t\n\nOne two three\n\nFour inline\n\na\n\nb"
    assert html.extract("<script>var a='<p>x</p>'</script>plain < text &copy;", []) == "plain < text ©"


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([c + s * rng.normal(size=(25, 24)) for c, s in zip(centres, rng.uniform(0.02, 0.5, 60), strict=True)] + [centres[0] + 0.05 * rng.normal(size=(700, 24))])
    x[::2] = x[::2].astype(np.float32)  # floats and doubles
    label = rng.integers(0, 2, len(x))
    label[1500:] = 0  # one hot list
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    out = {r.vec_id: r for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= embed.THRESHOLD) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = link.sum(1)
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum()
    low = roots(len(x), *np.nonzero(link))
    assert np.mean([out[i].component_id == low[i] for i in range(len(x))]) >= 0.999


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_by_stars_and_in_one_task(spark, one_task):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1_000 + i, 1_001 + i) for i in range(40)] + [(2_000, 2_000 + i) for i in range(300)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint"), one_task).collect()}
    up = roots(2_400, *np.array(pairs).T)
    assert out == {n: int(up[n]) for a, b in pairs if a != b for n in (a, b)}


def weighted_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] * bool(w)))
    return out


def test_near_duplicates_of_hot_groups_equal_brute_force(spark, monkeypatch):
    """Weighted shingles, groups around the threshold, buckets of several blocks, repeated ids with other texts."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 3_000, 120)]
    texts = [" ".join(base)] * 3
    for k in range(150):  # copies with one to nine words changed: similarities on both sides of the threshold
        own = list(base)
        for i in rng.choice(len(own), 1 + k % 9, replace=False):
            own[i] = f"n{k}x{i}"
        texts.append(" ".join(own))
    phrase = "one two three four five six seven"
    texts += [" ".join([phrase] * n) for n in (10, 11, 12, 20)] + [" ".join(f"z{rng.integers(10**6)}" for _ in range(60)) for _ in range(40)] + ["", None, "a b", "a b"]
    rows = [(i if i < 190 else 7, t) for i, t in enumerate(texts)]  # the last ones share an id with a copy
    got = {(r.id, bytes(r.digest)): r for r in minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets, up = weighted_sets(texts), list(range(len(texts)))
    probability = lambda a, b: sum(1 / sum(max(a[z] / a[x], b[z] / b[x]) for z in set(a) | set(b)) for x in set(a) & set(b))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and (texts[i] == texts[j] or probability(sets[i], sets[j]) >= 0.8 - 1e-12):
                up[max(find(i), find(j))] = min(find(i), find(j))
    import hashlib

    smallest: dict[int, int] = {}
    for i, (n, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), n), n)
    for i, (n, t) in enumerate(rows):
        key = n, hashlib.md5(t.encode()).digest() if t is not None else b""
        assert got[key].class_id == (smallest[find(i)] if sets[i] else n), (i, t)
    kept = [r for r in got.values() if r.kept and r.class_id is not None]
    assert len(got) == len({(n, t) for n, t in rows}) and sum(r.kept for r in got.values()) == len({find(i) for i in range(len(texts)) if sets[i]}) + sum(not s for s in sets)
    assert all(r.id == r.class_id for r in kept)


def test_one_of_each_class_stays_with_its_columns(spark):
    clean = lambda k: " ".join(f"c{k}w{i}" for i in range(40))
    rows = [(1, clean(1), "b"), (1, clean(1), "a"), (1, clean(2), "c"), (2, clean(1), "d"), (None, clean(1), "e"), (None, clean(3), "f"), (3, None, "g"), (4, "", "h"), (5, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k string").withColumnRenamed("k", "digest")
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.digest for r in out.collect()) == ["a", "c", "f", "g", "h", "i"]
    assert minhash.keep_one(docs.limit(0)).count() == 0
