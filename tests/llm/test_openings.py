from .conftest import prose
from .test_decontam import found

SHORT = (1, "Which trees lose their needles in every cold autumn?")
SUM = (2, "What is 12 + 7?")
UNIT = (3, "Days pass slowly where nobody counts their number")
PROBLEM = (4, "Anna sells 12 kg of apples and plums to Boris today")
ITEMS = [SHORT, SUM, UNIT, PROBLEM]


def test_items_inside_sentences_and_without_usable_windows(spark, docs):
    q = SHORT[1]
    texts = ["My notes\n" + q, "he asked, " + q, "he asked (" + q + ")", "he asked \"" + q + "\" again", q,
             "see that " + SUM[1], "see that What is 12 + 8?", "after 12 " + UNIT[1] + ".", "they say " + PROBLEM[1],
             "they say " + PROBLEM[1].replace("Anna", "Clara").replace("12", "40"), "he asked, " + q.replace("lose", "keep"),
             "What is 7 + 12?", prose(1, 60), "Days. " + UNIT[1].lower()]
    got = found(spark, docs, texts, ITEMS)
    assert set(got) == {(i, 1) for i in range(5)} | {(5, 2), (7, 3), (8, 4), (9, 4), (13, 3)}
    assert all(got[i, 1]["verbatim"] and got[i, 1]["n_windows"] == got[i, 1]["item_windows"] for i in range(5))
    assert got[5, 2]["verbatim"] and got[8, 4]["verbatim"] and not got[9, 4]["verbatim"]


def test_slots_of_the_opening_word(spark, docs):
    item = (1, "Anna sells 12 kg of apples and plums to Anna today")
    texts = ["they say " + item[1], "they say " + item[1].replace("Anna", "Clara"), "they say " + item[1].replace("Anna", "Clara", 1)]
    assert set(found(spark, docs, texts, [item])) == {(0, 1), (1, 1)}
