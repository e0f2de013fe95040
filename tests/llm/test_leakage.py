import numpy as np

from tesseral.llm import leakage

ITEM = [f"word{chr(97 + i)}{chr(110 - i // 2)}x" for i in range(20)]
OTHER = "entirely different talk stands here"


def leaks(text, item=" ".join(ITEM)):
    words = item.split()
    return leakage.find_leaks([text], leakage.SeedIndex([1], [words], 15, 6))


def test_passage_spans():
    state = np.array([0] * 16 + [2] + [0] * 15 + [2] + [0] * 14)
    assert leakage.passage_spans(state, 15, 6) == [(0, 15), (17, 31)]
    assert leakage.passage_spans(np.array([1, 1, 1] + [0] * 15), 15, 6) == [(0, 17)]
    assert leakage.passage_spans(np.array([1, 1, 1] + [0] * 13), 15, 6) == [(1, 15)]
    assert leakage.passage_spans(np.zeros(14, int), 15, 6) == []


def test_every_passage_of_a_pair_is_a_span():
    whole = " ".join(ITEM)
    assert leaks(f"{whole} {OTHER} {whole}") == [(0, 0, 0, 19), (0, 0, 25, 44)]
    long = [f"{w}{v}" for v in "ab" for w in ITEM]
    parted = " ".join([*long[:16], "zzzzzzzzzz", *long[17:]])
    assert leaks(parted, " ".join(long)) == [(0, 0, 0, 15), (0, 0, 17, 39)]


def test_all_passages_are_blanked_and_a_pair_is_found_once(spark):
    whole = " ".join(ITEM)
    docs = spark.createDataFrame([(7, f"{whole} {OTHER} {whole}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, whole)], "item_id long, item_text string")
    got = leakage.leaked_passages(docs, items)
    assert got.count() == 2
    assert [r["clean_text"] for r in leakage.blank_leaked_spans(docs, got).collect()] == [OTHER]


def test_damaged_short_words():
    for a, b in (("thc", "the"), ("ivc", "ive"), ("dcr", "der"), ("hin", "him"), ("clay", "day")):
        assert leakage.is_damaged_form(a, b)
    for a, b in (("if", "of"), ("we", "is"), ("the", "then"), ("a", "o")):
        assert not leakage.is_damaged_form(a, b)


def test_a_damaged_short_word_does_not_break_a_passage():
    words = [*ITEM[:8], "the", *ITEM[8:15]]
    for damaged in ("thc", "tho"):
        text = " ".join([*words[:8], damaged, *words[9:]])
        assert leaks(text, " ".join(words)) == [(0, 0, 0, 15)]
