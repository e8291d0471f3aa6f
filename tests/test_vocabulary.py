"""The vocabulary automaton and term rules, against plain searches and pairs."""

from __future__ import annotations

import random
from functools import lru_cache

import pytest

from tessera.functions import vocabulary as V


def test_all_words_are_found_in_one_pass():
    rng = random.Random(1)
    for _ in range(200):
        words = {"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        text = "".join(rng.choices("abcd", k=30))
        want = {(s, s + len(w)) for w in words for s in range(len(text)) if text.startswith(w, s)}
        found = list(V.Vocabulary(words).matches(text))
        assert set(found) == want and len(found) == len(want)


def plain_breaks(term, words, haystack):
    @lru_cache(None)
    def ok(at):
        return at == len(term) or any((term[at:e] in words or (e - at >= 2 and haystack and V.has_term(haystack, term[at:e]))) and ok(e) for e in range(at + 1, len(term) + 1))

    return ok(0)


def test_word_break_equals_a_search():
    rng = random.Random(2)
    seen = set()
    for _ in range(600):
        words = {"".join(rng.choices("ab文", k=rng.randrange(1, 4))) for _ in range(3)}
        term = "".join(rng.choices("ab文", k=rng.randrange(2, 9)))
        haystack = rng.choice(["", "ab 文a", "a文ab", "文文 b"])
        got = V.Vocabulary(words).breaks(term, haystack)
        assert got == plain_breaks(term, words, haystack)
        seen.add(got)
    assert seen == {True, False}


def test_ascii_terms_are_whole_words():
    assert not V.has_term("detail of it", "ai") and V.has_term("an ai-lab", "ai") and V.has_term("x detail ai", "ai") and V.has_term("文書aiの", "ai")
    assert V.has_term("文書館", "書館")


VOCABULARY = V.Vocabulary(["研究", "内容", "教え", "場所", "学費", "the", "of", "data"])
RULES = V.TermRules(stop=r"(?:19|20)\d{2}年?|誰|何時", scope=("大学",), run="[一-龥々ァ-ヴー]+|[a-z0-9][a-z0-9/+._-]*")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("研究内容を教えて", []), ("大学の量子計算の研究は?", ["量子計算"]), ("2024年の図書館の場所", ["図書館"]), ("犬の話", ["犬", "話"]), ("走り方", []), ("誰が猫を", ["猫"]),
        ("GPU B200 の data", ["gpu", "b200"]), ("ＧＰＵとGPU", ["gpu"]), ("42", []), (None, []), ("", []), ("研究室", ["研究室"]), ("thedata of", []),
    ],
)
def test_content_terms(text, want):
    assert V.content_terms(text, VOCABULARY, RULES) == want


def test_language_gate():
    assert V.content_terms("quantum", VOCABULARY, V.TermRules(needs="[ぁ-ん一-龥]")) == []


def test_coverage_and_credit():
    same = {"生まれ": ("出身", "birth")}
    assert V.covered("量子研究", "量子の話", VOCABULARY) and not V.covered("量子研究", "光の話", VOCABULARY)
    assert V.covered("生まれ", "彼の出身は", VOCABULARY, same) and not V.covered("生まれ", "birthday", VOCABULARY, same)
    assert V.credit("図書館", "新しい図書の棚", VOCABULARY) == pytest.approx(0.5 * 2 / 3)
    assert V.credit("研究x", "研究", VOCABULARY) == 0.0


def test_unmatched_qualifiers():
    ask = lambda q, e: V.unmatched_qualifier(q, e, "選抜", ("について", "の"), ("大学",))
    assert ask("大学の推薦選抜は", "一般選抜のみ") == "推薦" and ask("推薦選抜", "推薦選抜あり") == "" and ask("大学推薦選抜と総合選抜", "推薦") == "推薦選抜と総合" and ask(None, "") == ""


def test_column_forms(spark):
    df = spark.createDataFrame([(1, "図書館の研究", "図書館だ"), (2, None, None)], "id int, q string, t string")
    words = V.collected(spark.createDataFrame([("研究",), ("研究",)], "w string"))
    rows = df.withColumn("terms", V.content_terms_of(df.q, df, words, RULES))
    got = rows.select("id", "terms", V.coverage_of(rows.terms, rows.t, rows, words).alias("c")).orderBy("id").collect()
    assert [(r.terms, r.c) for r in got] == [(["図書館"], 1.0), ([], 1.0)]
    with pytest.raises(ValueError, match="more than"):
        V.collected(spark.range(5).selectExpr("cast(id as string) as w"), 3)
