"""Archives, packing, sharding, page text, licenses and pieces: round trips and brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from lodeworks.llm import html_text, licenses, packing, pieces, sharding, warc_store
from lodeworks.llm.common import Scratch, shared_dir
from lodeworks.llm.tokens import Encoder

TOKENIZER, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAGES = "page_id bigint, url string, html string"


# ---- archives


def pages():
    r = random.Random(2)
    big = "<p>" + "x" * 200 + "</p>"
    out = [(1, None, None), (2, "http://a.example/x y\n", ""), (3, "https://B.example:8080/p?q=1#f", big), (4, "http://a.example/1", big), (5, "http://a.example/1", "short"), (6, "http://a.example/1", "short"), (7, "not a url", "é" * 50)]
    return out + [(i, f"http://h{i % 7}.example.com/{r.randint(0, 30)}", "<p>" + str(r.randint(0, 40)) * 60 + "</p>") for i in range(10, 120)]


def expected(rows):
    first, out = {}, []
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and first[h or ""] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out)


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_store, "FILE_BYTES", 2000)
    rows = pages()
    with Scratch(spark) as scratch:
        folder, parts = f"{scratch.path}/a", f"{scratch.path}/i"
        captures = warc_store.write(spark.createDataFrame(rows, PAGES).repartition(4), folder, scratch)
        fences = warc_store.index(captures, parts, lines=4, per_part=20)
        assert len(fences) > 2
        read = warc_store.read(warc_store.find(captures, parts, fences), folder, payloads=True).collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read) == expected(rows)
        html = {i: h or "" for i, _, h in rows}
        assert all(bytes(r.payload).decode() == html[r.page_id] for r in read if r.record_type == "response")
        # All captures of some keys; keys that aren't there.
        asked = spark.createDataFrame([(warc_store.url_key("http://a.example/1"), None), ("no,such)/", None), ("", None), ("zzz)/", None)], "url_key string, page_id bigint")
        assert sorted(r.page_id for r in warc_store.find(asked, parts, fences).collect()) == [4, 5, 6]
        none = warc_store.write(spark.createDataFrame([], PAGES), folder, scratch)
        assert warc_store.index(none, f"{scratch.path}/none") == []


def test_all_captures_of_a_key_are_found_across_blocks_and_parts(spark):
    """Repeated keys and ids that fill whole blocks and parts, null ids, and a very long page."""
    rows = [(1, "http://a.example/1", "same")] * 40 + [(i, "http://a.example/1", str(i)) for i in range(2, 30)]
    rows += [(None, "http://a.example/1", "x" * 200), (None, None, "x" * 200), (90, "http://b.example/", "x" * 200), (91, "http://c.example/", "long " * 300_000)]
    with Scratch(spark) as scratch:
        folder, parts = f"{scratch.path}/a", f"{scratch.path}/i"
        made = spark.createDataFrame([(*r, "extra") for r in rows], PAGES + ", url_key string").repartition(3)
        captures = warc_store.write(made, folder, scratch)
        for lines in (1, 3, 100):
            fences = warc_store.index(captures, f"{parts}{lines}", lines=lines, per_part=7)
            found = warc_store.find(captures, f"{parts}{lines}", fences).collect()
            assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in rows)
            some = spark.createDataFrame([("example,a)/1", 1), ("example,a)/1", 29)], "url_key string, page_id bigint")
            assert sorted(r.page_id for r in warc_store.find(some, f"{parts}{lines}", fences).collect()) == [1] * 40 + [29]
        kinds = {(r.page_id, r.record_type) for r in warc_store.read(warc_store.find(captures, f"{parts}{lines}", fences), folder).collect()}
        assert {(None, "response"), (90, "response"), (91, "response")} <= kinds


def test_url_keys():
    assert warc_store.url_key("https://www.Example.com:443/a?b#c") == "com,example,www)/a?b"
    assert warc_store.url_key("http://x.org:81/") == "org,x:81)/"
    assert warc_store.url_key(None) == ")"


# ---- packing


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    r = random.Random(4)
    alphabet = "abcXYZ0159 \t\n'.,!_-éÉßüñ²½ﬁ中文😀́  　\x1c\x1f\x7f​"
    texts = [None, "", " ", "don't we'll I'm", "<|endoftext|>", "x<|endoftext|>y <|StartOfText|> <|startoftext|>", "a" * 5000, "İstanbul ΑΣ"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    for text, got in zip(texts, Encoder(TOKENIZER).many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_pieces_cover_all_tokens(spark):
    from tokenizers import Tokenizer

    plain, r = Tokenizer.from_file(TOKENIZER), random.Random(6)
    rows = [(0, None), (1, ""), (2, "word " * 9000)] + [(i, "".join(r.choice("abc de") for _ in range(r.randint(0, 900)))) for i in range(3, 80)]
    out = packing.pack(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int"), TOKENIZER, window=256).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for p in out:
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, t in rows:
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(own[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), TOKENIZER).count() == 0


def test_repeat_counts_are_nearly_the_best_nonnegative_ones():
    """Coordinate descent against many small projected gradient steps on the same least squares."""
    r = np.random.default_rng(5)
    hist = np.zeros(64, np.int64)
    hist[1:] = r.poisson(300 / np.arange(1, 64))
    combos = packing.combinations(hist, 64)
    a = np.array([np.bincount(c, minlength=64) for c in combos], float).T
    x, step = np.zeros(len(combos)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        x = np.maximum(0, x - step * (a.T @ (a @ x - hist)))
    best, ours = (np.square(a @ v - hist).sum() for v in (x, packing.repeats(combos, hist, sweeps=200)))
    assert (packing.repeats(combos, hist) >= 0).all() and ours <= best * 1.05 + 1


def test_patterns_use_up_the_histogram():
    r = np.random.default_rng(3)
    hist = np.zeros(512, np.int64)
    hist[1:] = r.poisson(4000 / np.arange(1, 512))
    plan = packing.patterns(hist, 512)
    used = np.zeros(512, np.int64)
    for own, n in plan:
        assert sum(own) <= 512 and n > 0
        used += n * np.bincount(own, minlength=512)
    assert (used == hist).all()
    total = sum(n for _, n in plan)
    assert total <= 1.01 * math.ceil((hist * np.arange(512)).sum() / 512) + 1


# ---- sharding


@pytest.mark.parametrize("n", [0, 5, 16, 1003])
def test_shards(spark, n):
    r = random.Random(n)
    rows = [(i, "t", r.choice(["hot"] * 6 + ["a", "b", None])) for i in range(n)]
    out = sharding.interleave(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), per_part=50).collect()
    assert sorted(x.doc_id for x in out) == list(range(n))
    shards = defaultdict(list)
    for x in out:
        shards[x.shard].append(x)
    sizes = [len(shards[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in shards.values())
    for source in {x[2] for x in rows}:
        each = [sum(x.source == source for x in shards[k]) for k in range(16)]
        assert max(each) - min(each) <= 2


# ---- page text


def test_marked_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class="cookie-notice">accept</div><article><h1>A &amp; B</h1><p>First <b>bold</b>
      line<br>more<script>if (a < b) {}</script><p>Second &#233;<aside>ad</aside><ul><li>x<li>y</ul></article><section id="comments"><p>me too</section><footer>f</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\nFirst bold line more\nSecond é\nx\ny"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x") == ""


@pytest.mark.parametrize("wrap", ["<div class='has-sidebar'>", "<div id='search-page'>", "<form id=aspnetForm>", "<div class='notice'>", "<div id=sidebar><div class=menu>"])
def test_wrappers_of_the_article_do_not_drop_it(wrap):
    rest = "<nav>menu</nav><div class='share-buttons'>share this</div><section id=comments><article class=comment>me too</article></section>"
    page = f"<body>{wrap}{{}}</div></form></body>"
    assert html_text.main_text(page.format(f"{rest}<article><p>the text of it all<form>mail</form></article>")) == "the text of it all"
    assert html_text.main_text(page.format(f"{rest}<main><p>the text of it all</main>")) == "the text of it all"


def test_small_marked_elements_still_go():
    assert html_text.main_text("<article>own text</article><div class=related><article>other</article></div>") == "own text"
    assert html_text.main_text("<div>a text of several words here</div><div id=comments><article>me too</article></div><div class=cookie-notice>yes</div><form>go</form>") == "a text of several words here"
    assert html_text.main_text("<form><div>a text of several words here</div><div class=site-footer>foot</div></form>") == "a text of several words here"


def test_suffix_arrays_group_equal_runs():
    tokens = np.array([1, 2, 3, 9, 1, 2, 3, 8, 2, 3, 9])
    order, rank = html_text.suffix_array(tokens, 2)
    suffix = lambda i: tokens[i : i + 2].tolist()
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(tokens)))
    assert all((rank[i] == rank[j]) == (suffix(i) == suffix(j)) for i in range(len(tokens)) for j in range(len(tokens)))


@pytest.mark.parametrize("group", [300, 2])
def test_repeats_decide_unmarked_pages(spark, monkeypatch, group):
    monkeypatch.setattr(html_text, "GROUP", group)
    boiler = "<div>all rights reserved by the company of this site</div>"
    rows = [(i, f"http://one.example/{i}", f"<div>{' '.join(f'w{i}x{j}' for j in range(20))}</div>{boiler}") for i in range(9)]
    rows += [(100, "http://two.example/", boiler), (101, None, None)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[i] == " ".join(f"w{i}x{j}" for j in range(20)) for i in range(9))
    assert found[100] == "all rights reserved by the company of this site" and found[101] == ""


@pytest.mark.parametrize("group", [300, 4])
def test_copies_keep_their_text(spark, monkeypatch, group):
    monkeypatch.setattr(html_text, "GROUP", group)
    boiler = "<div>all rights reserved by the company of this site</div>"
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(120))
    # Twelve distinct pages, one of them eight times, once with another word; pages without a host; two pages with a heading.
    rows = [(i, f"http://one.example/{i}", f"<div>{text(i)}</div>{boiler}") for i in range(12)]
    rows += [(20 + i, f"http://one.example/0?from={i}", f"<div>{text(0)}{' more' if i == 3 else ''}</div>{boiler}") for i in range(7)]
    rows += [(40 + i, None, f"<div>{text(99)}</div>") for i in range(4)]
    rows += [(50 + i, f"http://two.example/{i}", f"<div>how we make our bread</div><div>{text(70 + i)}</div>") for i in range(2)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[i] == text(i) for i in range(12))
    assert all(found[20 + i] == text(0) + (" more" if i == 3 else "") for i in range(7))
    assert all(found[40 + i] == text(99) for i in range(4))
    assert all(found[50 + i] == f"how we make our bread\n{text(70 + i)}" for i in range(2))


def test_repeats_are_cut_from_marked_articles(spark):
    note = "share this story with all of your friends today"
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(i, f"http://one.example/{i}", f"<main><p>{text(i)} {note if i % 2 else ''}</p><p>{note}</p></main>") for i in range(8)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {i: text(i) for i in range(8)}


def test_articles_keep_sentences_that_recur(spark):
    """Every text is that of the article's blocks, though prose recurs on many pages of the host; what frames all articles goes."""
    r = random.Random(9)
    sentences = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(9, 14))).capitalize() + "." for _ in range(40)]
    frame = "share this story with all of your friends today"
    rows, want = [], {}
    for i in range(60):
        own = [" ".join(r.choices(sentences, k=r.randint(1, 3))) for _ in range(r.randint(2, 6))]
        tail = f"<p>{frame}</p>" if i % 2 else ""
        rows.append((i, f"http://{'framed' if i % 2 else 'plain'}.example/{i}", f"<nav>{frame}</nav><article><h1>{i} title</h1>{''.join(f'<p>{x}</p>' for x in own)}{tail}</article><footer>{sentences[0]}</footer>"))
        want[i] = "\n".join([f"{i} title", *own])
    found = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == want


@pytest.mark.parametrize("group", [300, 3])
def test_heads_that_stand_within_other_articles_go(spark, monkeypatch, group):
    """A notice at the head of one article and the tail of another, in the middle of the host's others."""
    monkeypatch.setattr(html_text, "GROUP", group)
    note = "share this story with all of your friends today"
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(300))
    rows = [(i, f"http://one.example/{i}", f"<article><p>{text(i)}</p><p>{note}</p><p>{text(50 + i)}</p></article>") for i in range(8)]
    rows += [(8, "http://one.example/8", f"<article><p>{note}</p><p>{text(8)}</p></article>"), (9, "http://one.example/9", f"<article><p>{text(9)}</p><p>{note}</p></article>")]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {**{i: f"{text(i)}\n{note}\n{text(50 + i)}" for i in range(8)}, 8: text(8), 9: text(9)}


def test_long_frames_go_whole(spark):
    """A notice of more words than FRAME at the tail of all articles of a host."""
    notice = " ".join(f"n{j}" for j in range(5 * html_text.FRAME))
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(700 if k % 2 else 20))
    rows = [(i, f"http://one.example/{i}", f"<article><p>{text(i)}</p><p>{notice}</p></article>") for i in range(6)] + [(50, "http://two.example/", f"<article><p>{text(3)}</p><p>{notice}</p></article>")]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {**{i: text(i) for i in range(6)}, 50: f"{text(3)}\n{notice}"}


# ---- licenses


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any fee").replace("Software", "SOFTWARE")
    rows = [(1, f"intro text here\n{mit}\nend"), (2, f"a b c {changed}"), (3, "nothing like it " * 500), (4, None), (5, ""), (6, f"{mit} and once more {mit}"), (7, mit[: len(mit) // 2])]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("license = 'MIT'").collect()
    found = sorted((r.doc_id, r.start, r.end, r.coverage == 1) for r in out)
    one = rows[0][1].index("Permission")
    assert found[0] == (1, one, one + len(mit) - 1, True)
    assert [f[0] for f in found] == [1, 2, 6, 6] and not found[1][3]


@pytest.mark.parametrize("text, want", [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("under the GNU Lesser General Public License, version 3", "LGPL-3.0"), ("Released under the BSD License.", None),
    ("(c) A. All rights reserved. ", "All-rights-reserved"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Licensed under the Apache License, Version 1.1.", None), ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
])
def test_lines_are_told_apart(text, want):
    found = [m[0] for m in licenses.Scanner(licenses.TEMPLATES).scan(f"first words {text} last words")]
    assert len(found) == (want is not None) and all(x.startswith(want) for x in found)


def test_whole_texts_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("MIT-full", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0", "CC-BY-SA-4.0"):
        found = scanner.scan(f"some words {licenses.TEMPLATES[name]} other words")
        assert max(found, key=lambda x: x[1])[0] == name and max(x[3] for x in found if x[0] == name) > 0.95, name
    words = licenses.TEMPLATES["MIT-full"].split()
    split = " ".join(words[:80] + ["and", "a", "page", "header", "of", "nine", "words", "or", "so"] + words[80:])
    assert [(m[0], m[3]) for m in scanner.scan(split)] == [("MIT-full", 1.0)]


def test_alignment_equals_the_full_one():
    """Within a band as wide as the texts the banded score is that of the plain dynamic programme."""
    r = np.random.default_rng(7)
    for _ in range(30):
        a, b = r.integers(0, 6, r.integers(1, 12)).astype(np.uint64), r.integers(0, 6, r.integers(1, 12)).astype(np.uint64)
        n, first, end = licenses.align(a, b, -12, 12)
        score, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(len(a)):
            for j in range(len(b)):
                score[i + 1, j + 1] = max(0, score[i, j] + (2 if a[i] == b[j] else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
                best = max(best, score[i + 1, j + 1])
        assert (best > 0) == (n > 0) and 2 * n >= best and 0 <= first <= end <= len(b)


def test_long_odd_pages_take_time_in_proportion():
    import time

    for page in ("<a " * 350_000, "<a \"" * 250_000, "<a \">\"" * 150_000, "<a '\">" * 150_000, "<!--" * 250_000, "<" * 1_000_000, "<script>" * 120_000, "<p" * 300_000 + ">", "<![CDATA[" * 100_000):
        began = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - began < 10, page[:20]


def test_scripts_go_and_formulas_stay():
    page = "<article><p>before</p><script src=x />var leaked=1;</script><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><svg><title>t</title><text>label</text></svg><style>p{}</style><p title='a>b'>after &amp; on</p></article>"
    assert html_text.main_text(page) == "before\na x=2 b\nlabel\nafter & on"
    assert html_text.main_text("<p>kept <b class=x'>bold</b> end</p>") == "kept bold end"
    assert html_text.main_text("<p>open <script>never closed <p>gone") == "open"


def test_suffixes_that_few_share_are_left_out():
    r = np.random.default_rng(5)
    for least in (1, 2, 5):
        tokens = r.integers(0, 4, 300)
        order, rank = html_text.suffix_array(tokens, 5, least)
        suffix = lambda i: tokens[i : i + 5].tolist()  # noqa: B023, E731
        counts = defaultdict(int)
        for i in range(300):
            counts[tuple(suffix(i))] += 1
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(300) if len(suffix(i)) == 5 and counts[tuple(suffix(i))] >= least or least == 1)
        assert len(set(rank[order].tolist())) == len({tuple(suffix(i)) for i in order}) and (rank >= 0).sum() == len(order)


def test_words_and_sketches_of_many_pages_equal_those_of_each():
    r = random.Random(4)
    texts = [" ".join(r.choices(["a", "bc", "é", "😀", "long" * 30, *map(str, range(200))], k=n)) for n in (0, 1, 2, 4, 5, 6, 40, 3000, 0, 90)]
    words, sizes = html_text._each(texts)
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert words.tolist() == [int(html_text._hashed([w])[0]) for t in texts for w in t.split()]
    assert html_text.bands(words, sizes).to_pylist() == [html_text.bands(*html_text._each([t])).to_pylist()[0] for t in texts]
    assert len(set(html_text._hashed([f"w{i}" for i in range(20_000)]).tolist())) > 19_995


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_runs_equal_in_part_are_told_apart(spark, monkeypatch, sent):
    """Words of different pages whose hashes agree in 16 bits only are no repeats; also with runs joined, not sent."""
    monkeypatch.setattr(html_text, "MOST_SENT", sent)
    words = [f"w{i}" for i in range(200_000)]
    full, like = html_text._hashed(words), defaultdict(list)
    for w, h in zip(words, full.tolist()):
        like[h & 0xFFFF].append(w)
    alike = [own[:8] for own in like.values() if len(own) >= 8][:10]
    assert len(alike) == 10 and len(set(html_text._hashed([w for own in alike for w in own]).tolist())) == 80
    boiler, head = "all rights reserved by the company of this site", "share this story with all of your friends"
    own = [" ".join(x[i] for x in alike) for i in range(8)]
    rows = [(i, f"http://one.example/{i}", f"<p>text {i} {own[i]}</p><p>{boiler}</p>") for i in range(8)]
    rows += [(10 + i, f"http://two.example/{i}", f"<article><p>{head}</p><p>{own[i]}</p></article>") for i in range(8)]
    found = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {**{i: f"text {i} {own[i]}" for i in range(8)}, **{10 + i: own[i] for i in range(8)}}


def test_hashes_and_sketches_cost_less_than_the_parse():
    import time

    import pyarrow as pa

    r = random.Random(5)
    pages = ["<nav><ul>" + "<li><a href='/x'>x</a></li>" * 8 + "</ul></nav><article>" + "".join(f"<p>{' '.join(str(r.getrandbits(40)) for _ in range(70))}</p>" for _ in range(7)) + "</article>" for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "url": ["u"] * 1000, "host": ["h"] * 1000, "html": pages})

    def took(make):
        began = time.process_time()
        make()
        return time.process_time() - began

    assert min(took(lambda: list(html_text._parsed([batch]))) for _ in range(3)) < 2 * min(took(lambda: [html_text.blocks(p) for p in pages]) for _ in range(3))


def test_repeated_runs_equal_those_of_all_substrings(spark):
    """Every run of a small host's pages, counted page by page."""
    r = random.Random(3)
    vocabulary = ["w" + str(i) for i in range(300)]
    common = [" ".join(r.choices(vocabulary, k=12)) for _ in range(6)]
    rows, streams = [], []
    for i in range(40):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(5, 30))) for _ in range(3)] + r.sample(common, r.randint(0, 3))
        r.shuffle(parts)
        rows.append((i, f"http://h.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"))
        streams.append(" ".join(parts).split())
    need, counts = max(html_text.LEAST_PAGES, math.ceil(len(rows) * html_text.SHARE)), defaultdict(set)
    for i, words in enumerate(streams):
        for k in range(len(words) - 4):
            counts[tuple(words[k : k + 5])].add(i)
    host = html_text._MAIN_OF + "h.example"
    want = {int(html_text.run_hashes(html_text._hashed(list(run)), 5, host)[0]) for run, on in counts.items() if len(on) >= need}
    pages = spark.createDataFrame([(*x, "h.example") for x in rows], "page_id bigint, url string, html string, host string")
    with Scratch(spark) as scratch:
        for group in (300, 7):
            html_text.GROUP, before = group, html_text.GROUP
            try:
                found = {x.run for x in html_text.repeated_runs(pages, scratch).collect() if x.host == host}
            finally:
                html_text.GROUP = before
            assert found == want and want


def test_scan_equals_a_search_by_alignment_alone(spark):
    """All templates aligned with all of each text, without fingerprints, finds the same licenses."""
    r = random.Random(12)
    names = ["MIT-line", "CC-BY-4.0-line", "GPL-3.0-header", "Apache-2.0-line", "MPL-2.0-header", "LGPL-2.1-header"]
    rows, want = [], {}
    for i in range(40):
        own = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(0, 60))]
        if i % 3:
            name = r.choice(names)
            notice = licenses.TEMPLATES[name].split()
            if i % 3 == 2:
                notice.insert(len(notice) // 2, "also")
            at = r.randint(0, len(own))
            own[at:at] = notice
        rows.append((i, " ".join(own)))
    own = {n: licenses.TEMPLATES[n] for n in names}
    scanner = licenses.Scanner(own)
    for i, text in rows:
        h = scanner._hashed(text)
        hits = {n for n, t in zip(scanner.names, scanner.hashes, strict=True) if (k := licenses.align(t, h, -len(t), len(h))[0]) >= licenses.LEAST * len(t) and licenses.allowed(n, len(t), " ".join(licenses._WORD.findall(text.lower())))} if len(h) else set()
        want[i] = hits
    docs = spark.createDataFrame([*((i, t, 1) for i, t in rows), (None, None, 2), (99, "", 3)], "doc_id bigint, text string, start int")
    found = defaultdict(set)
    for x in licenses.scan(docs, own).collect():
        found[x.doc_id].add(x.license)
    assert {i: found[i] for i, _ in rows} == want and sum(map(bool, want.values())) >= 25
    assert licenses.scan(docs.limit(0)).count() == 0


def test_many_notices_in_one_long_text_are_quick():
    import time

    text = " ".join(["Some words before it.", licenses.TEMPLATES["GPL-3.0-header"]] * 1200)
    began = time.process_time()
    found = licenses.Scanner(licenses.TEMPLATES).scan(text)
    assert sum(x[0] == "GPL-3.0-header" for x in found) == 1200 and time.process_time() - began < 60


# ---- pieces


def lattice_paths(lattices, word):
    """All segmentations of a word with their log probabilities, by listing them."""
    def walk(i):
        if i == len(word):
            yield (), 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in lattices.vocabulary:
                n, w = lattices.vocabulary[word[i:j]]
                for rest, x in walk(j):
                    yield (n, *rest), w + x
        if i < len(word) and word[i] not in lattices.vocabulary:
            data = word[i].encode()
            for rest, x in walk(i + 1):
                yield (*(lattices.bytes[c] for c in data), *rest), lattices.byte_weight * len(data) + x

    weights = defaultdict(list)
    for path, w in walk(0):
        weights[path].append(w)
    total = math.log(sum(math.exp(w) for own in weights.values() for w in own))
    return {path: math.log(sum(map(math.exp, own))) - total for path, own in weights.items()}


@pytest.mark.parametrize("text", ["hello", "so it is", "x😀é"])
def test_samples_are_distinct_and_drawn_by_their_shares(text):
    """Also the second sample, given the first: by the shares of the paths that are left."""
    lattices = pieces.Lattices(MODEL)
    normal = lattices.model.normalize(text)
    words = [lattice_paths(lattices, w) for w in lattices.words.findall(normal)]
    paths = {(): 0.0}
    for own in words:
        paths = {a + b: x + y for a, x in paths.items() for b, y in own.items()}
    n, first, second = 6000, defaultdict(int), defaultdict(int)
    for own in pieces.sample(lattices, [normal] * n, list(range(n)), 3):
        assert len({tuple(s[0]) for s in own}) == min(3, len(paths))
        assert all(x[2] >= y[2] for x, y in zip(own, own[1:]))
        for ids, lp, _, inclusion in own:
            assert lp == pytest.approx(paths[tuple(ids.tolist())]) and 0 < inclusion <= 1
        first[tuple(own[0][0].tolist())] += 1
        second[tuple(own[1][0].tolist())] += 1
    p = {path: math.exp(lp) for path, lp in paths.items()}
    for path in p:
        then = sum(p[a] * p[path] / (1 - p[a]) for a in p if a != path)
        for found, share in ((first[path], p[path]), (second[path], then)):
            assert abs(found / n - share) < 5 * math.sqrt(max(0, share * (1 - share)) / n) + 1e-3


def test_inclusion_scores_weigh_samples_without_bias():
    """Shares weighed by the inverse of the chance to be above the last sample add up to one, on average."""
    lattices = pieces.Lattices(MODEL)
    normal = lattices.model.normalize("abcd")
    paths = lattice_paths(lattices, normal)
    n = 3000
    found = [sum(math.exp(lp) / -math.expm1(-math.exp(lp - own[-1][2])) for _, lp, _, _ in own[:-1]) for own in pieces.sample(lattices, [normal] * n, list(range(n)), 4)]
    assert len(paths) > 4 and np.mean(found) == pytest.approx(1, abs=5 * np.std(found) / math.sqrt(n))


def test_lattices_of_words_are_made_once_and_remembering_changes_nothing(monkeypatch):
    lattices, r = pieces.Lattices(MODEL), random.Random(8)
    words = ["hello", "so", "naïve", "😀", "x" * 400, "a\nb", "\n", "it", "\u2581", "été", *map(str, range(40))]
    texts = [lattices.model.normalize(" ".join(r.choices(words, k=30))) for _ in range(20)] + ["", "▁▁a b▁", "a▁▁\n\nb"]
    for t in texts:
        number, size = lattices.numbers([t])
        names = list(lattices.number)
        assert [names[i] for i in number.tolist()] == lattices.words.findall(t) and size.tolist() == [len(number)]
    made, edges = [], lattices.edges
    monkeypatch.setattr(lattices, "edges", lambda *x: made.append(x) or edges(*x))
    want = pieces.sample(lattices, texts, list(range(len(texts))))
    assert not made
    monkeypatch.setattr(pieces, "EDGES", 200)
    few = pieces.Lattices(MODEL)
    found = [pieces.sample(few, [t], [i])[0] for i, t in enumerate(texts)]
    assert [[s[0].tolist() for s in own] for own in found] == [[s[0].tolist() for s in own] for own in want]
    assert [s[1:] for own in found for s in own] == [pytest.approx(s[1:]) for own in want for s in own]


def test_few_paths_and_round_trip(spark):
    lattices = pieces.Lattices(MODEL)
    own = pieces.sample(lattices, ["", "", "▁a"], [1, 2, 3], 50)
    assert [s[0].tolist() for s in own[0] + own[1]] == [[], []] and own[0][0][3] == 1.0
    assert all(s[3] == 1.0 for s in own[2]) and {tuple(s[0].tolist()) for s in own[2]} == set(lattice_paths(lattices, "▁a"))
    texts = ["Hello world", "naïve 😀 text", "tabs\tand  spaces", None, " a\n", "▁ x\u2581", "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    from pyspark.sql import functions as F

    out = pieces.decode(pieces.sample_pieces(rows, MODEL, F.col("k"), F.col("t")), MODEL).collect()
    norm = {str(i): lattices.model.decode(lattices.model.encode(t or "")) for i, t in enumerate(texts)}
    assert {r.key for r in out} == set(norm) and all(r.text == norm[r.key] and r.round_trip for r in out)
    assert pieces.sample_pieces(rows.limit(0), MODEL, F.col("k"), F.col("t"), carry=("t",)).count() == 0


def test_all_documents_are_sampled_and_decoded(spark, tmp_path):
    texts = ["Hello world", None, "", "tabs\tand  spaces 😀", "a long text " * 3000, "no id"]
    rows = [(i if t != "no id" else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = pieces.op9(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows} and all(r.round_trip for r in out)
    assert all(sum(r.doc_id == i for r in out) == (2 if t else 1) for i, t in rows)


def test_samples_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"some text number {i} to be cut") for i in range(60)], "k int, t string")
    take = lambda df: sorted((r.key, r.sample, tuple(r.ids)) for r in pieces.sample_pieces(df, MODEL, F.col("k"), F.col("t")).collect())
    assert take(rows.repartition(1)) == take(rows.repartition(9))


def test_shared_dir_is_the_one_of_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
