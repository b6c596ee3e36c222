"""References of languages with few documents, with many languages, and against brute force."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pytest

from chatloom.llm import quality
from chatloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string"


def prose(seed, n=150):
    rng = np.random.default_rng(seed)
    common = ["the", "of", "and", "to", "in", "is", "it", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else f"word{chr(97 + rng.integers(26))}{rng.integers(9000)}" for _ in range(n)) + "."


def junk(seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("#@!%$&*<>")) for _ in range(6)) for _ in range(150))


@pytest.mark.parametrize("many", [5, 18, 19, 20, 40, 200])
def test_the_same_row_is_judged_alike_among_few_and_many(spark, many):
    rows = [(i, prose(i), "zz") for i in range(many)] + [(1000, junk(1), "zz"), (1001, prose(9999), "zz")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept.pop(1000) is False and all(kept.values())


def test_a_rare_language_is_no_reason(spark):
    """One or two clean documents of a language lie near their own reference."""
    rows = [(i, prose(i), "en") for i in range(60)] + [(100 + k, " ".join(f"слово{k}{i}" for i in range(200)), f"l{k // 2}") for k in range(6)]
    assert all(r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect())


def test_rows_that_fail_the_base_rules_shape_no_reference(spark):
    """A hot source of repeated junk in a language leaves its clean documents alone."""
    bad = "#@!% " * 200
    rows = [(i, prose(i), "zz") for i in range(20)] + [(1000 + i, bad, "zz") for i in range(100)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [kept[i] for i in range(20)] == [True] * 20 and not any(kept[1000 + i] for i in range(100))


def test_references_of_many_languages_are_joined(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sent = quality.quality_rules(docs)
    joined = quality.quality_rules(docs, quality.Rules(max_languages=1))
    assert joined.columns == sent.columns
    rows = lambda df: sorted((r.doc_id, r.kept, r.class_distance, r.word_distance) for r in df.collect())
    assert [x[:2] for x in rows(sent)] == [x[:2] for x in rows(joined)]
    for a, b in zip(rows(sent), rows(joined)):
        assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a[2:], b[2:]))


def test_distances_equal_brute_force(spark, sf_dir):
    rules, rows = quality.Rules(), table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()

    def kind(c):
        if "\t" <= c <= "\r":
            return "space"
        if c in quality.SYMBOLS:
            return "S"
        x = unicodedata.category(c)
        return {"Ll": "Ll", "Lu": "Lu", "Lt": "Lu", "Nd": "Nd", "Zs": "space", "Zl": "space", "Zp": "space"}.get(x, {"L": "L", "M": "L", "N": "N", "P": "P", "S": "S"}.get(x[0], "N"))

    def shares(counts):
        total = sum(counts.values())
        return {k: n / total for k, n in counts.items()}

    def words(text):
        out, word = Counter(), ""
        for c in text.lower() + " ":
            if ord(c) > 127 or c.isalnum():
                word += c
            elif word:
                out[word] += 1
                word = ""
        return out

    def distance(p, q):
        halves = 0.0
        for a, b in ((p, q), (q, p)):
            halves += sum(x * math.log2(x / ((x + b.get(k, 0)) / 2)) for k, x in a.items() if x > 0) / 2
        return math.sqrt(max(0.0, halves))

    good = {}
    for r in rows:
        counts = quality.base_counts(r.text)
        if r.lang and r.text and len(r.text) >= rules.min_chars and not quality.base_fails(counts[0], counts[4]):
            good.setdefault(r.lang, []).append(r.text)
    reference = {}
    for lang, texts in good.items():
        classes, seen, n = Counter(), Counter(), 0
        for t in texts:
            for k, x in shares(Counter(map(kind, t))).items():
                classes[k] += x
            w = words(t)
            if sum(w.values()) >= rules.min_words:
                n += 1
                for k, x in shares(w).items():
                    if len(k) <= rules.word_letters and k.isalpha():
                        seen[k] += x
        top = dict(sorted(seen.items(), key=lambda x: (-round(x[1], 9), x[0]))[: rules.common_words])
        common = {k: x / n for k, x in top.items()}
        reference[lang] = (shares(classes), common | {None: 1 - sum(common.values())}, len(texts), n)
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, sf_dir, "documents")).collect()}
    for r in rows:
        mine = got[r.doc_id]
        counts = quality.base_counts(r.text)
        near = True
        if r.text and r.lang in reference and len(r.text) >= rules.min_chars:
            classes, common, n, n_words = reference[r.lang]
            far = distance(shares(Counter(map(kind, r.text))), classes)
            assert math.isclose(mine.class_distance, far, abs_tol=1e-6)
            near = far <= rules.class_limit + rules.class_slack / len(r.text) ** 0.5 + rules.few_slack / n**0.5
            w = words(r.text)
            if sum(w.values()) >= rules.min_words:
                own = {k: w[k] for k in common if k is not None}
                far = distance(shares(own | {None: sum(w.values()) - sum(own.values())}), common)
                assert math.isclose(mine.word_distance, far, abs_tol=1e-6)
                near = near and far <= rules.word_limit + rules.word_slack / sum(w.values()) ** 0.5 + rules.few_slack / n_words**0.5
        assert mine.kept == (near and not quality.base_fails(counts[0], counts[4]))
