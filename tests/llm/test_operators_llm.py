"""Each operator against a brute-force version, and on nulls, empty texts, repeats and empty tables."""

import base64
import hashlib
import io
import re
import zipfile
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from chatloom.llm import licences, line_dedup, mixing, packing, ppm, quality, spotsigs, template, tensored, zipwarc
from chatloom.llm.common import table
from chatloom.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, block int"


def sentence(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in draw.integers(0, 500, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and blank texts, repeats, a copy and columns that clash with results."""
    base = sentence(1, 120)
    rows = [
        (1, base, "en", "a", 5, "x", 1),
        (2, base, "en", None, 5, "x", 2),
        (3, base.replace("w", "v", 1), "en", "a", 5, None, 3),
        (4, None, "en", "b", None, "x", 4),
        (5, "", None, "b", 0, "x", 5),
        (6, " \n\t ", "fr", "c", 3, "x", 6),
        (7, sentence(2, 40), "xx", "c", 3, "x", 7),
        (7, sentence(2, 40), "xx", "c", 3, "x", 7),
        (None, sentence(3, 40), None, None, None, None, None),
        (8, "one two", "en", "b", 7, "x", 8),
        (9, "Released under the MIT License.\n" + sentence(4, 4000), "en", "b", 7, "x", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


def words(text):
    return (text or "").encode().split()


def test_quality_counts(spark, sf_dir, texts):
    for r in QUERIES["op10_distribution_divergence"](spark, sf_dir).collect():
        text = texts[r.doc_id]
        w = words(text)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert r.n_words == len(w) and r.n_repeat_words == len(cover)
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rejects_what_lies_far_from_its_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    junk = " ".join("#@!%" for _ in range(200))
    more = spark.createDataFrame([(10**6, junk, "en", "a", 1)], docs.schema)
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs.unionByName(more.selectExpr(*docs.columns))).collect()}
    assert kept[10**6] is False
    assert sum(kept.values()) > len(kept) * 0.7


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([2.0, 2]), np.array([1.0, 1])) == 0


def test_quality_edges(spark, odd):
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == 11 and all(r.base_failed for r in rows if not words(r.text))
    assert quality.quality_rules(odd.limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    ids, sets, root = sorted(texts), {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, sf_dir, texts):
    want = brute_groups(texts)
    for r in QUERIES["op5_tensored_minhash"](spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_finds_chains_in_one_bucket(spark):
    """A chain whose ends are far apart: most members fail against the smallest id."""
    word = [f"w{i}" for i in range(400)]
    texts = {}
    for k in range(12):
        word[k * 25 : k * 25 + 2] = [f"x{k}", f"y{k}"]
        texts[k] = " ".join(word)
    want = brute_groups(texts)
    got = tensored.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_from_four_fifths_on(spark):
    """Planted pairs between 0.80 and 0.85, and some under 0.80, which stay; tables grow with the threshold."""
    rows, want = [], set()
    for k in range(120):
        word = [f"d{k}w{i}" for i in range(304)]
        other = list(word)
        for at in range(6 if k % 3 else 9):  # five shingles each: 300 less 30 or 45 shared
            other[20 + 30 * at] = "x"
        a, b = shingles(" ".join(word)), shingles(" ".join(other))
        near = 100 * len(a & b) >= 80 * len(a | b)
        assert 100 * len(a & b) < 85 * len(a | b) and near == bool(k % 3)
        rows += [(2 * k, " ".join(word)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} if near else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in tensored.near_duplicates(docs, percent=80).collect() if r.kept} == want
    assert tensored.halves(85) == 10 and (1 - (1 - 0.8**3) ** tensored.halves(80)) ** 2 > 0.9998


def test_near_duplicates_edges(spark, odd):
    got = {(r.doc_id, r.n_shingles): r for r in tensored.near_duplicates(odd).collect()}
    assert got[2, 116].component_id == 1 and not got[2, 116].kept
    assert got[4, 0].kept and got[5, 0].kept and got[6, 0].kept
    assert got[None, 36].component_id is None and got[None, 36].kept
    assert tensored.near_duplicates(odd.limit(0)).count() == 0


def test_patience():
    a, b = list("xabcy"), list("pabcq")
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience(list("abab"), list("abab")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([], [1]) == []
    assert line_dedup.common_blocks([1, 5, 6, 2], [5, 6, 9], {6}) == [1, 2]
    assert line_dedup.common_blocks([1, 5, 6, 2], [5, 6, 9], {2}) == []


def test_line_dedup(spark):
    shared = [sentence(s, 30) for s in (11, 12)]
    rows = [
        (1, "\n".join([sentence(20, 12), *shared, "end."])),
        (2, "\n".join([sentence(21, 12), "short", *shared, sentence(22, 12)])),
        (3, "\n".join([sentence(23, 12), "end."])),
        (4, "\n".join([sentence(20, 12), *shared, "end."])),
        (5, None),
        (6, ""),
        (None, shared[0]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as removed", "'a' as partners")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[None].text == shared[0]
    assert got[2].text == "\n".join([sentence(21, 12), "short", sentence(22, 12)]) and got[2].partners == [1]
    assert got[4].text == "" and got[4].n_removed == 4
    assert got[5].text is None and got[6].text == "" and got[6].n_removed == 0
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_what_very_many_share(spark):
    """Lines of 8 to 19 words and passages of short lines go from all later texts, however many there are."""
    phrase = sentence(30, 9)
    passage = [sentence(40 + k, 6) for k in range(9)]
    rows = []
    for i in range(90):
        own = [sentence(1000 + 2 * i, 12), sentence(1001 + 2 * i, 12)]
        rows.append((i, "\n".join([own[0], phrase, own[1], "see also:", "", *passage, "end."])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 90):
        assert got[i] == f"{sentence(1000 + 2 * i, 12)}\n{sentence(1001 + 2 * i, 12)}"
    few = [(1, "\n".join(["a b c", "", "", "x y", "a b c"])), (2, "\n".join(["q", "a b c", "", "", "x y", "r"]))]
    kept = line_dedup.line_dedup(spark.createDataFrame(few, "doc_id long, text string")).collect()
    assert {r.text for r in kept} == {t for _, t in few}


def test_patience_matches_runs_without_unique_lines():
    a, b = list("pabcqabcr"), list("sabctabcabcu")
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (3, 3), (5, 5), (6, 6), (7, 7)]
    assert line_dedup.patience(list("p-q-"), list("-r-s"), {"-"}) == []


def test_line_dedup_keeps_the_first_of_every_line(spark, sf_dir, texts):
    left = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, sf_dir, "documents")).collect()}
    kept = {x.strip(" ") for t in left.values() for x in t.split("\n")}
    assert {x.strip(" ") for t in texts.values() for x in t.split("\n")} <= kept | {""}


def test_mixing(spark, sf_dir, texts):
    first = QUERIES["op9_pivotal_mixing"](spark, sf_dir).collect()
    again = {r.doc_id: r.taken for r in QUERIES["op9_pivotal_mixing"](spark, sf_dir).collect()}
    assert {r.doc_id: r.taken for r in first} == again
    per = {}
    for r in first:
        assert r.size == len(words(texts[r.doc_id])) and r.taken in (0, r.size, 2 * r.size)
        per.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in rows) for s, rows in per.items()}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    budget, want, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:  # share, stop what is full, share the rest
        level = (budget - sum(want.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in full} if full else {s: weights[s] * level for s in open_}
        open_ = open_ - full if full else set()
    for s, rows in per.items():
        assert rows[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in rows) - want[s]) <= max(r.size for r in rows)


def test_mixing_edges(spark, odd):
    rows = mixing.mixed_sizes(odd).collect()
    assert len(rows) == 11 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mixed_sizes(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_dominance_and_best_fit():
    draw = np.random.default_rng(3)
    for _ in range(40):
        counts = np.zeros(101, np.int64)
        for size in draw.integers(1, 101, 200):
            counts[size] += 1
        runs = packing.plan_runs(counts, 100)
        fill, seen = Counter(), Counter()
        for size, start, sequence, each, _ in runs:
            total = [r for r in runs if r[0] == size and r[1] > start]
            upto = min((r[1] for r in total), default=counts[size])
            for k in range(upto - start):
                fill[sequence + k // each] += size
            seen[size] += upto - start
        assert all(seen[s] == counts[s] for s in range(101)) and max(fill.values()) <= 100
        least = -(-sum(s * int(counts[s]) for s in range(101)) // 100)
        assert len(fill) <= least * 1.1 + 2
    counts = np.zeros(11, np.int64)
    counts[[9, 6, 4]] = 2
    assert packing.dominance(counts, 10) == [([(9, 1)], 2), ([(6, 1), (4, 1)], 2)] and not counts.any()


def test_packing(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    strange = ["a  b", " lead", "trail ", "tab\tx y", "line \n x", "  nb", "<|endoftext|> z", "é\nü ß", "x" * 9000, None]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    docs = docs.unionByName(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id < 60"))
    rows = packing.packed(docs, tokenizer_path()).collect()
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs.collect():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(odd, tokenizer_path()).count() >= 11
    assert packing.packed(odd.limit(0), tokenizer_path()).count() == 0


def test_spotsigs(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in QUERIES["op2_spotsigs"](spark, sf_dir).collect()}
    ids = sorted(texts)
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(x.split()) for x in (r.fingerprint, r.edited_fingerprint, rows[r.next_doc_id].fingerprint))
        assert r.near_edited == pytest.approx(len(a & b) / max(1, len(a | b)))
        assert r.near_next == pytest.approx(len(a & c) / max(1, len(a | c)))
    anchors = set(spotsigs.ANCHORS)
    for doc_id in ids[:60]:
        w = texts[doc_id].lower().translate(str.maketrans("", "", spotsigs._MARKS)).split()
        chains = {
            " ".join([x for x in w[i:] if x not in anchors][:3])
            for i in range(1, len(w))
            if w[i - 1] in anchors and w[i] not in anchors
        }
        assert len(rows[doc_id].fingerprint.split()) == (len(chains) or min(1, len(w)))


def test_spotsigs_pairs(spark):
    draw = np.random.default_rng(8)
    base = [int(x) for x in draw.integers(0, 10**9, 60)]
    sets = {1: base, 2: base[:55] + [1, 2], 3: base, 4: [5, 6, 7], 5: base[:30], 6: []}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, signatures array<long>")
    members, pairs = spotsigs.similar_fingerprints(frame)
    assert {r.id: r.class_id for r in members.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == {(1, 2)}


def test_spotsigs_edges(spark, odd):
    rows = spotsigs.edited_fingerprints(odd).collect()
    assert len(rows) == 11
    assert all(r.fingerprint == "" for r in rows if r.n_chars == 0)
    assert spotsigs.edited_fingerprints(odd.limit(0)).count() == 0
    assert spotsigs.edited_fingerprints(odd.where("doc_id = 1")).first().near_next == 1.0


def test_template_text():
    page = (
        "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1>"
        "<p>One  two<br>three<p>x&lt;y <b>bo</b>ld<div class='ad'>buy</div><script>var t='</p>'</script>"
        "<ul><li>i<li>j</ul><section id=comments><p>nice!</section></article><footer>f</footer>"
    )
    assert template.main_text(page, None, set()) == "A & B\nOne two three\nx<y bold\ni\nj"
    assert template.main_text("", None, set()) == ""


def test_template_extraction(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    from html import unescape

    for r in QUERIES["op3_template_deduction"](spark, sf_dir).collect():
        inside = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_template_without_names(spark):
    """No element is named article: the root class element that holds the varying text is found."""
    page = "<body><div id=top>Home</div><div id=x7><p>{}</p><p>Tail {}</p></div><div class=footer>(c)</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(sentence(i, 30), i)) for i in range(12)]
    rows += [(90, None, None), (91, "http://other.example/", "")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as main", "2 as host")
    got = {r.page_id: r.text for r in template.extracted(docs).collect()}
    assert got[3] == f"{sentence(3, 30)}\nTail 3" and got[90] == "" and got[91] == ""
    assert template.extracted(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "opening",
    [
        "<body class='has-sidebar'><div><article class='post comment-open'>",
        "<body class='search-results'><div class='no-sidebar'><article>",
        "<body><div class='content with-sidebar'><main class='with-sidebar'>",
        "<body><div class='sidebar widget'><article>",
    ],
)
def test_template_names_of_states_hide_nothing(spark, opening):
    page = opening + "<p>Kept {0}</p><div class='comment-list'>bad {0}</div><div class=sidebar>bad</div>"
    assert template.main_text(page.format(1), None, set()) == "Kept 1"
    docs = spark.createDataFrame([(i, "http://h/", page.format(i)) for i in range(3)], "page_id long, url string, html string")
    assert [r.text for r in template.extracted(docs).orderBy("page_id").collect()] == ["Kept 0", "Kept 1", "Kept 2"]


def test_template_of_unnamed_articles(spark):
    """Siblings of one article, long notices, long class lists, hosts of two pages, copies of one page."""
    notice = sentence(70, 120)
    long_list = " ".join(f"k{i}" for i in range(60)) + " content"

    def pages(host, body, n):
        return [(100 * ord(host) + i, f"http://{host}/", "<body>" + body.format(sentence(300 + i, 40), sentence(400 + i, 20))) for i in range(n)]

    rows = [
        *pages("a", f"<div id=t>Home</div><div id=x><div id=y><p>{{0}}</div><div id=z><p>{{1}}</div></div><div id=n>{notice}</div>", 12),
        *pages("b", f"<div id=t>{{1}}</div><div class='{long_list}'><p>{{0}}</div>", 3),
        *pages("c", "<div id=t>Home</div><div id=x><p>{0}</div>", 2),
        *[(10000 + i, "http://d/", f"<body><p>{notice}") for i in range(2)],
        *pages("e", "<div class='page-widget'><p>{0}</div>", 3),
    ]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {f"{chr(r.page_id // 100)}{r.page_id % 100}": r.text for r in template.extracted(docs).collect()}
    assert got["a3"] == f"{sentence(303, 40)}\n{sentence(403, 20)}"
    assert got["b1"] == sentence(301, 40) and got["c1"] == sentence(301, 40)
    assert got["d0"] == notice and got["e2"] == sentence(302, 40)


def test_licence_scan(spark, odd):
    model = licences.trained([sentence(s, 25) for s in range(200)])
    for family, templates in licences.TEMPLATES.items():
        for text in templates:
            assert licences.FAMILIES[int(model.probabilities(text).argmax())] == family
    rows = {(r.doc_id, r.n_paragraphs): r for r in licences.licence_scan(odd, model).collect()}
    assert rows[9, 2].families == "MIT" and rows[9, 2].likeness == 1.0
    assert rows[4, 0].family is None and rows[8, 1].families == ""
    assert licences.licence_scan(odd.limit(0)).count() == 0


def test_licence_scan_scores_every_paragraph(spark):
    """Licence lines without a word like licence, and paragraphs that are unknown; the sample has none near a template."""
    found = {
        "Distributed under CC BY-SA 4.0.": "CC-BY-SA",
        'of this software and associated documentation files (the "Software"), to deal': "MIT",
        "in the Software without restriction, including without limitation the rights": "MIT",
    }
    rows = [(k, "\n".join([sentence(k, 25), line, "", sentence(900 + k, 25)])) for k, line in enumerate(found)]
    rows += [(k, sentence(k, 25) + "\nThe licence fee of this firm is due in the month of May.") for k in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    for k, family in enumerate(found.values()):
        assert (got[k].families, got[k].n_paragraphs, got[k].unknown_paragraphs) == (family, 3, 2)
    plain = spark.createDataFrame([(1, "and the\nto use\nthat can be found in the")], "doc_id long, text string")
    assert licences.licence_scan(plain, licences.trained([sentence(s, 25) for s in range(200)])).first().families == ""
    sample = licences.background_paragraphs(docs)
    assert "The licence fee of this firm is due in the month of May." in sample and len(sample) == len(set(sample)) == 197
    assert not set(found) & set(sample) and len(licences.background_paragraphs(docs, 20)) == 20
    text = licences.TEMPLATES["MIT"][2] + " zzz qqq of this"
    model = licences.trained([sentence(s, 25) for s in range(200)], 5)
    want = licences.grams(text)
    assert list(model.row(text)[0][:-2]) == sorted({model.places[g] for g in want if g in model.places})
    assert model.row(text)[1][-2] == pytest.approx(1 - sum(g in model.places for g in want) / len(want))


def test_licence_held_out():
    model = licences.trained([sentence(s, 25) for s in range(200)])
    held = licences.training_paragraphs(seed=99, each=40)
    right = sum(licences.FAMILIES[int(model.probabilities(t).argmax())] == f for t, f in held)
    assert right / len(held) > 0.93


def test_ppm(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in QUERIES["op6_ppm"](spark, sf_dir).collect()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter()
    for i in train:
        counts.update([*texts[i].encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, r in rows.items():
        w = [*texts[i].encode().lower().split(), None]
        assert r.held_out == (i not in set(train)) and r.n_tokens == len(w) and r.train_tokens == total
        assert r.n_known == sum(counts[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(log10((counts[x] + 1) / (total + kinds + 1)) for x in w))
    # The trie against escapes and exclusions written out for one text.
    seen = [{} for _ in range(ppm.ORDER + 1)]
    for i in train:
        data = ppm._PADDING + texts[i].encode().lower() + bytes([ppm.END])
        for at in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                seen[k].setdefault(data[at - k : at], Counter())[data[at]] += 1
    i = min(set(rows) - set(train))
    data, score = ppm._PADDING + texts[i].encode().lower() + bytes([ppm.END]), 0.0
    for at in range(ppm.ORDER, len(data)):
        gone: set = set()
        for k in range(ppm.ORDER, -2, -1):
            if k < 0:
                score += log10(1 / (256 - len(gone)))
                break
            node = seen[k].get(data[at - k : at])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in gone}
            if data[at] in left:
                score += log10((left[data[at]] - 0.5) / sum(left.values()))
                break
            if left:
                score += log10(0.5 * len(left) / sum(left.values()))
            gone = set(node)
    assert rows[i].score == pytest.approx(score)


def test_ppm_bounds_of_what_is_sent_change_nothing(spark, odd):
    few = {(r.doc_id, r.n_tokens): r for r in ppm.scored(odd, "doc_id in (3, 8)", 40, 3).collect()}
    for r in ppm.scored(odd, "doc_id in (3, 8)").collect():
        other = few[r.doc_id, r.n_tokens]
        assert other.n_known == r.n_known and other.held_out == r.held_out
        assert other.score == pytest.approx(r.score) and other.base_score == pytest.approx(r.base_score)


def test_ppm_edges(spark, odd):
    rows = ppm.scored(odd).collect()
    assert len(rows) == 11 and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert ppm.scored(odd.limit(0)).count() == 0


def test_zip_directories():
    members = [("archive/data.warc", b"x" * 1000), ("indexes/index.cdx", b""), ("é", b"1")]
    for zip64 in (False, True):
        data = zipwarc.zip_bytes(members, zip64)
        assert {n: zipfile.ZipFile(io.BytesIO(data)).read(n) for n, _ in members} == dict(members)
        file = zipwarc.RangeFile(data)
        directory = zipwarc.zip_directory(file)
        assert {n: zipwarc.member(file, directory, n) for n, _ in members} == dict(members)
    with pytest.raises(ValueError):
        zipwarc.zip_directory(zipwarc.RangeFile(b"no archive"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"y" * 500)
    file = zipwarc.RangeFile(packed.getvalue())
    with pytest.raises(ValueError):
        zipwarc.member(file, zipwarc.zip_directory(file), "a")


def test_zip_archives(spark):
    rows = [(5, "http://a/", "x"), (2, "http://b/\r\nX: y", "x"), (9, None, None), (4, "http://c/", ""), (7, "u", "é\r\n\r\nz"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first")
    for least in (0, 1):
        got = {r.page_id: r for r in zipwarc.archived(pages, least).collect()}
        for page_id, _, html in rows:
            data = (html or "").encode()
            r = got[page_id]
            assert r.payload_bytes == len(data)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[2].record_type, got[5].record_type, got[5].refers_to) == ("response", "revisit", 2)
        assert (got[9].record_type, got[9].refers_to) == (("revisit", 4) if least == 0 else ("response", None))
        assert got[None].refers_to == 2
    assert zipwarc.archived(pages.limit(0)).count() == 0


def test_pipeline(spark, sf_dir, texts):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    frame, sizes = docs, []
    for name, stage in p.STAGES[:-1]:
        from chatloom.llm.common import landed

        frame = landed(stage(spark, frame, sf_dir), "t")
        assert frame.columns == docs.columns, name
        sizes.append(frame.count())
    assert sizes[0] < docs.count() and sizes[2] <= sizes[1] <= sizes[0]
    near = {r.doc_id: r.text for r in landed(p.STAGES[2][1](spark, docs, sf_dir), "t").collect()}
    want = brute_groups(texts)
    assert set(near) == {i for i, (_, c) in want.items() if c == i}
    pieces = p.STAGES[-1][1](spark, frame, sf_dir)
    assert pieces.where("piece = 0").count() == sizes[3]
    assert sorted(p.run(spark, sf_dir).drop("sequence_id", "offset").collect()) == sorted(
        pieces.drop("sequence_id", "offset").collect()
    )
