"""Splitting, scoring, requests, responses, drafting, governance, snapshots on hand-written rows."""

import json
import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chatloom.functions import scoring
from chatloom.operators import drafting, evaluate, governance as gv, render, responses as rs, snapshots as sn, split
from chatloom.sources import sinks

MSG = "messages array<struct<role:string,content:string>>"


# --- split -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n,f,k", [(10, 0.1, 1), (2, 0, 0), (2, 0.5, 1), (1, 0.5, 0), (0, 0.5, 0), (25, 0.1, 2), (35, 0.1, 4), (4, 1.0, 3), (4, 9.0, 3)])
def test_split_sizes(spark, n, f, k):
    rows = spark.range(n).withColumnRenamed("id", "sample_id")
    found = {r.split: r["count"] for r in split.split_records(rows, f, 42).groupBy("split").count().collect()}
    assert found.get("eval", 0) == k and found.get("train", 0) == n - k


def test_split_members_are_the_smallest_hashes(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(split, "_DIGITS", 1)
    monkeypatch.setattr(split, "_RANKABLE", 3)
    rows = spark.range(700).select(F.concat(F.lit("s"), "id").alias("sample_id"))
    got = {r.sample_id for r in split.split_records(rows, 0.37, 7).filter("split = 'eval'").collect()}
    ranked = sorted((hashlib.md5(f"7:s{i}".encode()).hexdigest(), f"s{i}") for i in range(700))
    assert got == {x for _, x in ranked[: round(700 * 0.37)]}
    other = {r.sample_id for r in split.split_records(rows, 0.37, 8).filter("split = 'eval'").collect()}
    assert got != other


def test_split_filters_without_shuffle(spark):
    rows = spark.range(1000).withColumnRenamed("id", "sample_id")
    plan = split.split_records(rows, 0.1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_latest_checkpoint(spark):
    rows = [("r", "o/checkpoint-9", 5), ("r", "o/checkpoint-10", 7), ("r", "o/other", 9), ("q", "o/x", 1), ("t", "a/checkpoint-1", 2), ("t", "a/checkpoint-2", 2)]
    found = split.latest_checkpoint(spark.createDataFrame(rows, "run_id string, path string, mtime long"))
    assert {r.run_id: r.checkpoint for r in found.collect()} == {"r": "o/checkpoint-10", "q": None, "t": "a/checkpoint-2"}


# --- evaluation ------------------------------------------------------------------------------


def shared_run(a, b):
    """Length of the longest common subsequence, by trying all of them."""
    runs = lambda w: {c for n in range(len(w) + 1) for c in combinations(w, n)}
    return max(map(len, runs(a) & runs(b)))


def test_scores_by_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "B", "b", "c\td", "é", "ﬁ", "x,", "\r"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randint(0, 9)))
    pairs = [(i, text(), text()) for i in range(300)] + [(300, "", ""), (301, " ", "a"), (302, "a", ""), (303, " a ", "a"), (304, "Red Fox", "red hen")]
    frame = spark.createDataFrame(pairs, "i int, pred string, gold string")
    for r in evaluate.score(frame).collect():
        p, g = (re.findall(r"[^ \n]+", x.strip().lower()) for x in (r.pred, r.gold))
        total = max(1, len(p) + len(g))  # F1 of precision and recall is the Dice coefficient
        assert r.exact_match == (r.pred.strip() == r.gold.strip())
        shorter, longer = sorted((len(r.pred), len(r.gold)))
        assert r.length_ratio == (shorter / longer if r.gold else 0.0)
        hits = sum(min(p.count(w), g.count(w)) for w in set(p))
        assert r.bleu == r.token_f1 and math.isclose(r.token_f1, 2 * hits / total), (r.pred, r.gold)
        assert math.isclose(r.rouge_l, 2 * shared_run(p, g) / total), (r.pred, r.gold)


def test_empty_summary_is_null(spark):
    none = spark.createDataFrame([], "pred string, gold string")
    row = evaluate.eval_summary(evaluate.score(none)).first()
    assert row.turns == 0 and all(row[m] is None for m in evaluate.METRICS)


def py_bleu(pred, gold):
    """Clipped n-gram precisions over plain words, halved for each empty order."""
    p, g = pred.split(), gold.split()
    if len(p) < 4 or not set(p) & set(g):
        return 0.0
    total, half = 0.0, 1.0
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))  # noqa: E731,B023
        hit, all_ = (grams(p) & grams(g)).total(), len(p) - n + 1
        if not hit:
            half *= 2
        total += math.log(hit / all_ if hit else 1 / (half * all_))
    return math.exp(total / 4) * (math.exp(1 - len(g) / len(p)) if len(p) < len(g) else 1.0)


def test_bleu4(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
    pairs = [(text(), text()) for _ in range(100)] + [("the cat sat on the mat", "the cat sat on the mat"), ("x y", "x y")]
    rows = evaluate.score(spark.createDataFrame(pairs, "pred string, gold string"), ("bleu",), bleu4=True).collect()
    assert all(math.isclose(r.bleu, py_bleu(r.pred, r.gold), abs_tol=1e-12) for r in rows)
    cut = spark.createDataFrame([("Hi, it's 3.5 &amp; 1,000-x.",)], "t string").select(scoring.bleu_tokens(F.col("t")).alias("t")).first().t
    assert cut == ["Hi", ",", "it's", "3.5", "&", "1,000", "-", "x", "."]


def test_assistant_turns_and_predictions(spark):
    chat = [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", None)]
    frame = spark.createDataFrame([("s", chat), ("t", [("assistant", "first")])], f"sample_id string, {MSG}")
    gold = {(r.sample_id, r.turn_no): (r.gold, [m.content for m in r.prompt]) for r in evaluate.assistant_turns(frame).collect()}
    assert gold == {("s", 1): ("a1", ["q1"]), ("s", 3): ("", ["q1", "a1", "q2"]), ("t", 0): ("first", [])}
    preds = spark.createDataFrame([("s", 1, None), ("s", 3, "p")], "sample_id string, turn_no int, pred string")
    joined = evaluate.attach_predictions(evaluate.assistant_turns(frame, False), preds)
    assert {(r.sample_id, r.turn_no): r.pred for r in joined.collect()} == {("s", 1): "", ("s", 3): "p", ("t", 0): ""}


# --- rendering and exports ---------------------------------------------------------------------


def test_renderings(spark):
    row = spark.createDataFrame([([("user", " hi\n  there "), (None, "x")],), ([("system", "s")],)], MSG)
    got = row.select(
        render.render_training_text(F.expr("filter(messages, m -> m.role is not null)")).alias("t"),
        render.render_prompt(F.col("messages")).alias("p"),
        render.sample_title(F.col("messages"), F.lit(7)).alias("title"),
    ).collect()
    assert got[0].t == "<|im_start|>user\n hi\n  there <|im_end|>\n<|im_start|>assistant\n"
    assert got[0].p == "user:  hi\n  there \nuser: x\nassistant:"
    assert [r.title for r in got] == ["hi there", "样本 7"]


def test_conversations_of_any_length_are_one_text(spark):
    rows = [(1, t, "user" if t % 2 else "bot", f" m{t} " if t != 9 else " ") for t in range(5000)] + [(2, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = render.render_turns(turns).collect()
    chat = [("user" if t % 2 else "assistant", f"m{t}") for t in range(5000) if t != 9]
    whole = spark.createDataFrame([(chat,)], MSG).select(render.render_training_text(F.col("messages"))).first()[0]
    assert (got.conv_id, got.n_messages, got.text) == (1, 4999, whole)


def test_thousands_of_secrets(spark):
    secrets = tuple(f"sk-{i}" for i in range(5000)) + ("a+b", "c\\d")
    frame = spark.createDataFrame([("x sk-4999 sk-49 a+b c\\d aab",)], "t string")
    assert frame.select(gv.redact_literal(F.col("t"), secrets)).first()[0] == "x *** *** *** *** aab"


def test_pair_export_does_not_resync(spark):
    chat = [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", " "), ("system", "s"), ("user", "d"), ("assistant", " e ")]
    frame = spark.createDataFrame([(1, chat), (2, [("user", "u"), ("system", "x"), ("assistant", "v")])], f"id int, {MSG}")
    got = [(r.id, r.pair_no, r.user, r.assistant) for r in sinks.export_pairs(frame).collect()]
    # 1: (a, b) (c, d) are skipped and e is left over; 2: the system message does not count.
    assert got == [(2, 0, "u", "v")]
    assert sinks.pair_text(sinks.export_pairs(frame)).first().value == "u\nv"


# --- requests and responses ----------------------------------------------------------------------


def test_requests(spark):
    bodies = [
        {}, {"max_tokens": 32}, {"max_completion_tokens": 64}, {"max_tokens": 0}, {"max_tokens": "x"}, {"max_tokens": " 1_0 "}, {"max_tokens": True},
        {"temperature": 0.7}, {"temperature": 0}, {"temperature": "1e-3"}, {"temperature": "1d"}, {"enable_thinking": True}, {"chat_template_kwargs": {"enable_thinking": True}},
        {"enable_thinking": False, "chat_template_kwargs": {"enable_thinking": True}}, {"prompt": ["a", "b"]}, {"prompt": 5}, {"messages": []},
        {"messages": [{"role": "user", "content": "m"}], "model": "M", "stream": True, "stream_options": {"include_usage": False}},
    ]
    rows = [(i, json.dumps(b), True) for i, b in enumerate(bodies)] + [(i + 100, json.dumps(b), False) for i, b in enumerate(bodies)] + [(999, "{", True)]
    got = {r.i: r for r in rs.normalize_request(spark.createDataFrame(rows, "i int, payload string, chat boolean")).collect()}
    assert [got[i].max_tokens for i in range(7)] == [256, 32, 64, 1, 256, 10, 1]
    assert [got[i].temperature for i in range(7, 11)] == [0.7, 0.0, 0.001, 0.0]
    assert [(got[i].do_sample, got[i].sampling_temperature) for i in (7, 8, 9)] == [(True, 0.7), (False, None), (True, 0.01)]
    assert [got[i].enable_thinking for i in (0, 11, 12, 13)] == [False, True, True, False]
    assert got[114].prompt == "a" and got[115].prompt == "5" and got[100].prompt == "" and got[114].messages is None
    assert [(m.role, m.content) for m in got[16].messages] == [("user", "")]
    assert [(m.role, m.content) for m in got[17].messages] == [("user", "m")] and got[17].model == "M" and got[17].stream
    assert not got[17].include_usage and got[0].include_usage and got[0].ok and not got[999].ok and got[999].max_tokens == 256


def test_response_texts(spark):
    texts = spark.createDataFrame([("<s><think>plan</think>hello</s>",)], "t string")
    assert texts.select(rs.strip_specials(F.col("t"), ("<s>", "</s>", "<pad>"))).first()[0] == "<think>plan</think>hello"
    merged = spark.createDataFrame([("answer", "plan"), ("<think>plan</think>answer", "ignored"), ("x", " "), ("y", None)], "t string, r string")
    assert [r[0] for r in merged.select(rs.merge_reasoning(F.col("t"), F.col("r"))).collect()] == ["<think>plan</think>answer"] * 2 + ["x", "y"]
    found = spark.createDataFrame([("a<think> x\ny </think>b<think>c</think>",), ("<think></think>",), ("none",)], "t string")
    assert [r[0] for r in found.select(rs.extract_reasoning(F.col("t"))).collect()] == ["x\ny", "", None]
    body = lambda m: json.dumps({"choices": [{"message": m}]})
    rows = [(0, 200, body({"content": "t", "reasoning": "r"})), (1, 200, body({"content": None})), (2, 500, '{"error":{"message":"boom"}}'),
            (3, 404, "html"), (4, 200, "html"), (5, 200, body({"content": "", "reasoning_content": "only"}))]
    got = {r.i: (r.text, r.error) for r in rs.parse_responses(spark.createDataFrame(rows, "i int, status int, body string"), status="status").collect()}
    assert got == {0: ("<think>r</think>t", None), 1: (None, "empty content"), 2: (None, "boom"), 3: (None, "HTTP 404"), 4: (None, "empty content"), 5: ("<think>only</think>", None)}


def test_long_completion_is_assembled_in_order(spark, monkeypatch):
    monkeypatch.setattr(rs, "CHUNK_BLOCK", 7)
    rows = [("x", s, f"[{s}]" if s % 5 else None, "stop" if s == 99 else ("length" if s == 50 else None), s if s > 97 else None) for s in range(100)]
    random.Random(4).shuffle(rows)
    got = rs.assemble_chunks(spark.createDataFrame(rows, "id string, seq long, content string, finish_reason string, total_tokens long")).first()
    assert got.content == "".join(f"[{s}]" for s in range(100) if s % 5) and (got.finish_reason, got.total_tokens, got.chunks) == ("stop", 99, 100)


# --- drafting --------------------------------------------------------------------------------------


def test_prompt_lists(spark):
    cases = {
        "": [], " ": [], '["a", {"prompt":"b"}, {"content":"c"}, {"prompt":""}, 5, ""]': ["a", "b", "c"], '{"prompts":["x", "", null, 7]}': ["x", "7"],
        '[null, "a"]': ['[null, "a"]'], 'Here:\n```json\n["p", 1, true, null, {"k":1}]\n```': ["p", "1", "true", "null", "[object Object]"],
        "```\nnot json\n```": ["```", "not json", "```"], "1. one\n 2) two\r\n- three\n* four\nx\n\n3.five": ["one", "two", "three", "four", "five"],
        '{"other":1}': ['{"other":1}'], "7": [], "null": ["null"], "a\\b 'q'": ["a\\b 'q'"],
    }
    frame = spark.createDataFrame([(c,) for c in cases], "t string").select("t", drafting.parse_prompt_list("t").alias("p"))
    assert {r.t: r.p for r in frame.collect()} == cases


def test_batches(spark):
    prompts = spark.createDataFrame([(" ask ",), (" ",)], "prompt string")
    rows = drafting.build_generation_batch(prompts, 2, "m", thinking=True).collect()
    assert [r.candidate for r in rows] == [1, 2]
    assert json.loads(rows[0].body) == {
        "model": "m", "messages": [{"role": "user", "content": "ask"}], "temperature": 0.7, "max_tokens": 256, "stream": False,
        "enable_thinking": True, "chat_template_kwargs": {"enable_thinking": True},
    }
    topic = drafting.build_prompt_requests(spark.createDataFrame([("t ",), ("",)], "topic string"), "m", 3).collect()
    assert len(topic) == 1 and json.loads(topic[0].body)["messages"][1]["content"] == "Topic:\\nt\\n\\nCount: 3"
    found = spark.createDataFrame([("p", "t", None), ("p", None, "e")], "prompt string, text string, error string")
    corpus = spark.createDataFrame([([("user", "u")],)], MSG)
    assert drafting.accept_candidates(corpus, found).count() == 2


# --- governance --------------------------------------------------------------------------------------


def test_licenses(spark):
    card = "---\nLicense: 'x'\nlicense:  \"MIT\" \nno colon\nurl: http://a:b\n---\n# m"
    rows = [
        ("front", "README.md", card), ("front", "LICENSE", "Apache 2.0"),
        ("fall", "README.md", "---\nlicense:\n---"), ("fall", "LICENSE.txt", "The Apache License 2.0? no.\nApache  2.0 text"),
        ("open", "README.md", "---\nlicense: mit"), ("open", "configuration.json", '{"license": "cc-by-nc-4.0"}'),
        ("bad", "configuration.json", "{"), ("blank", "LICENSE", "\n\n"), ("words", "LICENSE", "x" * 90), ("nc", "license", "\n\nGPL nc"),
    ]
    got = {r.model_id: r for r in gv.license_report(spark.createDataFrame(rows, "model_id string, file string, text string")).collect()}
    assert {k: (r.license, r.source_file, r.commercial_ok) for k, r in got.items()} == {
        "front": ("MIT", "README.md", True), "fall": ("Apache  2.0", "LICENSE.txt", True), "open": ("cc-by-nc-4.0", "configuration.json", False),
        "bad": (None, None, None), "blank": ("see LICENSE", "LICENSE", None), "words": ("x" * 80, "LICENSE", None), "nc": ("GPL nc", "license", False),
    }
    assert got["bad"].warning.startswith("No license") and got["front"].warning is None
    frame = spark.createDataFrame([("a", card)], "id string, text string")
    assert {(r.key, r.value) for r in gv.front_matter(frame).collect()} == {("license", "MIT"), ("url", "http://a:b")}
    gate = gv.license_gate(spark.createDataFrame([(True,), (False,), (None,)], "commercial_ok boolean"))
    assert gate.count() == 2
    word = spark.createDataFrame([("permit us",), ("the MIT license",)], "t string").select(gv.license_from_text(F.col("t"), True).alias("w"))
    assert [r.w for r in word.collect()] == ["permit us", "MIT"]


def test_secrets(spark):
    rows = spark.createDataFrame([("HF_TOKEN", "abcdefghijk"), ("MODEL_ID", "x"), ("API_KEY", "short")], "key string, value string")
    assert [r.value for r in gv.redact_settings(rows).collect()] == ["abcd***", "x", "***"]
    args = spark.createDataFrame([(["python", "--api-key", "sk-secret", "--token=abc", "--port", "1"],)], "a array<string>")
    assert args.select(gv.redact_args(F.col("a"))).first()[0] == ["python", "--api-key", "***", "--token=***", "--port", "1"]
    line = spark.createDataFrame([("sk-10 sk-1 a.c abc",)], "t string").select(gv.redact_literal(F.col("t"), ("sk-1", "sk-10", "a.c")))
    assert line.first()[0] == "*** *** *** abc"


# --- snapshots -----------------------------------------------------------------------------------------


def test_snapshots(spark):
    good = [("config.json", 2), ("tokenizer.json", 1), ("model.safetensors", 9)]
    rows = [("ok", *f) for f in good] + [("shards", *f) for f in good] + [("lora", "adapter_config.json", 0), ("empty", "config.json", 0), ("empty", "sub/deep/W.BIN", 1)]
    rows += [("vocab", "vocab.json", 0), ("vocab", "merges.txt", 0), ("vocab", "config.json", 1), ("vocab", ".bin", 5), ("broken", "config.json", 1)]
    listing = spark.createDataFrame(rows, "model_id string, path string, size long")
    shards = {f"w{i}": f"s-{i:02d}.safetensors" for i in range(12)} | {"m": "model.safetensors"}
    index = spark.createDataFrame([("shards", json.dumps({"weight_map": shards})), ("broken", "{"), ("ok", '{"weight_map": null}')], "model_id string, raw string")
    got = {r.model_id: r for r in sn.audit_snapshots(listing, index).collect()}
    assert got["ok"].problems == [] and got["ok"].kind == "merged"
    assert got["shards"].problems == [sn.NO_SHARDS + ", ".join(f"s-{i:02d}.safetensors" for i in range(8))]
    assert got["lora"].kind == "adapter" and len(got["lora"].problems) == 3
    assert got["empty"].problems == [sn.NO_CONFIG, sn.NO_TOKENIZER]
    assert got["vocab"].problems == [sn.NO_WEIGHTS]
    assert got["broken"].problems[-1] == sn.BAD_INDEX
    assert sn.missing_shards(listing, index).count() == 12
    tries = [("m", "hf", 0, "timeout"), ("m", "ms", 1, None), ("n", "hf", 0, "x"), ("n", "ms", 1, "y"), ("o", "hf", 0, None), ("o", "ms", 1, "late")]
    won = sn.first_valid_source(spark.createDataFrame(tries, "model_id string, source string, priority int, problem string")).collect()
    assert {r.model_id: (r.source, r.failures) for r in won} == {"m": ("ms", ["hf: timeout"]), "n": (None, ["hf: x", "ms: y"]), "o": ("hf", [])}
