import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import chunks, leaks, mixing, tokens

VOC = tokens.DEFAULT_VOCABULARY
DOCS = "doc_id bigint, text string, source string, item_id bigint, tokens int"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"
LONG = "x" * 300_000


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, 5, 1) for i, t, s in rows], DOCS)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_words():
    assert leaks.words("Ｆoo-bar_baz ﬁn­ish zero​width É é") == ["foo", "bar", "baz", "finish", "zerowidth", "é", "é"]
    assert leaks.words(None) == leaks.words("") == leaks.words("--- _ ---") == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBcé1ﬁ́­​_- \n中Ⅷ", max_size=40))
def test_spans_follow_the_words(text):
    assert [w for w, _, _ in leaks.words_with_spans(text)] == leaks.words(text)


def test_leaks_are_found_and_removed(spark):
    w = ITEM.split()
    d = docs(
        spark, (1, "prefix " + ITEM.upper().replace(" ", " -- ") + " suffix", "a"), (2, " ".join(w[:11]), "a"), (3, " ".join(w[1:13]), "a"),
        (4, None, "a"), (5, "", "a"), (6, LONG + " " + ITEM, "a"), (7, " ".join(w[:6] + ["gap"] + w[6:]), "a"), (8, ("word " * 50) + ITEM + " end", "a"), (1, ITEM, "a"),
    )
    e = items(spark, (10, ITEM), (11, "short"), (12, None), (13, "zero " + ITEM), (None, ITEM))
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked_items(d, e).collect())
    assert got == [(1, 10), (1, 10), (1, 13), (1, 13), (3, 10), (3, 13), (6, 10), (6, 13), (8, 10), (8, 13)]
    c = {r.doc_id: r for r in leaks.without_leaks(d, e).collect() if r.doc_id != 1}
    assert c[3].action == "document" and c[3].text is None
    assert c[8].action == "span" and c[8].removed_words == 13 and c[8].text == "word " * 50 + " end"
    assert leaks.leaked_items(d.limit(0), e).count() == 0 and leaks.leaked_items(d, e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks.leaked_items(d, e, max_items=2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefx"), max_size=60), st.lists(st.lists(st.sampled_from("abcdef"), max_size=12), max_size=4), st.integers(1, 4))
def test_scan_equals_plain_search(doc, its, n):
    grams, voc = leaks.item_ngrams([(i, " ".join(t)) for i, t in enumerate(its)], n)
    want = [(p, i) for p in range(len(doc) - n + 1) for i, t in enumerate(its) if any(t[q : q + n] == doc[p : p + n] for q in range(len(t) - n + 1))]
    assert [(p, i) for p, ids in leaks._hits(doc, grams, voc, n) for i in ids] == want


def test_token_counts(spark):
    d = docs(spark, (1, "hello world", "a"), (2, None, "b"), (3, "", None), (4, LONG, "a"), (5, "<|endoftext|>", "a"))
    got = {r.doc_id: r.tokens for r in tokens.token_counts(d.drop("tokens"), keep=("source",)).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1


def mix_of(spark, *rows):
    return spark.createDataFrame(list(rows), "mix_id bigint, total_ratio double, source string, target_share double, max_repeats bigint")


def test_mix_shares_repeats_and_shortfalls(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(5, 40), s) for i, s in enumerate(["big"] * 300 + ["Mid_size "] * 80 + ["small"] * 10)] + [(900, None, "big"), (901, "w w", None), (902, "", " ")]
    sized = mixing.sized_documents(docs(spark, *rows).drop("tokens"))
    size = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(size.values())
    mix = mix_of(spark, (1, 1.0, "big", 0.5, 1), (1, 1.0, "mid-size", 0.4, 9), (1, 1.0, "small", 0.1, 2), (2, 0.5, "nowhere", 1.0, 5), (3, 1.0, "big", 0.2, 0))
    rep = {(r.mix_id, r.source): r for r in mixing.mix_report(sized, mix).collect()}
    for (m, s), r in rep.items():
        assert r.short == (r.max_repeats * size.get(s, 0) < r.demand)
        assert min(r.demand, r.capacity) <= r.actual_tokens < min(r.demand, r.capacity) + 50 or r.capacity == r.actual_tokens
    assert rep[(1, "small")].short and not rep[(1, "mid-size")].short and rep[(2, "nowhere")].actual_tokens == 0 and rep[(3, "big")].documents == 0
    out = [r for r in mixing.mixed_documents(sized, mixing.mix_plan(sized, mix)).collect() if r.mix_id == 1]
    assert [r.position for r in out] == sorted(r.position for r in out) and 0 <= out[0].position and out[-1].position <= total
    for s, most in (("mid-size", 9), ("small", 2), ("big", 1)):
        n = {}
        for r in out:
            if r.source == s:
                n[r.doc_id] = n.get(r.doc_id, 0) + 1
        assert max(n.values()) <= most and max(n.values()) - min(n.values()) <= 1
    # the schedule: tokens of a source up to time t follow the integral of its weight
    slope = {r.source: r.slope for r in mixing.mix_plan(sized, mix).collect() if r.mix_id == 1}
    at = sum(r.tokens for r in out if r.source == "mid-size" and r.position < total / 2)
    assert at == pytest.approx(0.4 * total * (0.5 + slope["mid-size"] * (0.25 - 0.5)), abs=60)
    assert sum(s * w for s, w in zip((slope["big"], slope["mid-size"], slope["small"]), (0.5, 0.4, 0.1))) == pytest.approx(0)


def test_mix_of_nothing(spark):
    sized = mixing.sized_documents(docs(spark, (1, "a", "b")).limit(0).drop("tokens"))
    r = mixing.mix_report(sized, mix_of(spark, (1, 1.0, "b", 1.0, 1))).first()
    assert r.actual_tokens == 0 and not r.short  # nothing is demanded of nothing


def joined(rows):
    return "".join(r.text[r.body_start - r.start :] for r in sorted(rows, key=lambda r: r.piece_no))


def long_text(seed, crlf=False):
    rnd = random.Random(seed)
    out = []
    for f in range(12):
        out.append(f"diff --git a/f{f} b/f{f}")
        for h in range(4):
            out.append(f"@@ -{h},3 +{h},4 @@")
            out += ["+    " + " ".join(rnd.choice(["alpha", "beta(", "γάμμα", "导出", "x = 1", "é"]) for _ in range(9)) for _ in range(8)] + [""]
    return ("\r\n" if crlf else "\n").join(out)


def test_pieces_round_trip(spark):
    texts = {1: long_text(1), 2: long_text(2, True), 3: LONG, 4: "短い" * 9000, 5: "short", 6: None, 7: "", 8: "word " * 9000, 9: "\n" * 50_000, 10: "😀" * 4000}
    d = docs(spark, *[(i, t, "a") for i, t in texts.items()])
    by = {}
    for r in chunks.split_oversized(d, limit=512, overlap=64, least=128).collect():
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        n = len(tokens.encode(VOC, t)) if t else 0
        assert (i in by) == (n > 512)
        if i in by:
            assert joined(by[i]) == t and len(by[i]) == by[i][0].pieces >= 2
            for r in by[i]:
                assert r.tokens == len(tokens.encode(VOC, r.text)) <= 512
                assert r.piece_no == 0 or 0 < len(tokens.encode(VOC, r.text[: r.body_start - r.start])) <= 72
    cuts = [r.text[r.body_start - r.start :] for i in (1, 2) for r in by[i] if r.piece_no]
    assert sum(c.startswith(("diff", "@@", "+")) for c in cuts) == len(cuts)
    assert chunks.split_oversized(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunks.split_oversized(d, limit=100, overlap=60)


def test_edit_changes_neighbouring_pieces_only():
    t = "".join(long_text(i) + "\n" for i in range(4))
    lines = t.split("\n")
    lines.insert(len(lines) // 2, "+    an inserted line")
    bodies = lambda x: [x[a:b] for _, a, b, _ in chunks.pieces(x, VOC, 512, 0, 128)]
    a, b = bodies(t), bodies("\n".join(lines))
    assert len(set(b) - set(a)) <= 4 and len(a) > 20


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "\r\n", "foo bar", "导", "😀", "=" * 30, "\t", "1234567"]), min_size=30, max_size=400))
def test_any_text_round_trips(parts):
    t = "".join(parts)
    p = chunks.pieces(t, VOC, 64, 8, 16)
    if p is None:
        assert len(tokens.encode(VOC, t)) <= 64
    else:
        assert "".join(t[a:e] for _, a, e, _ in p) == t and all(n <= 64 for *_, n in p)
        assert all(s <= a < e for s, a, e, _ in p)
