"""Quantities and stated causes on sentences made for them."""

from rulelens.operators import answers

SENTENCES = [
    (1, 0, "Ten men, 20 dogs and ten cats"), (1, 1, "Only 7"), (1, 2, "tent often 3rd a4"), (2, 0, None), (2, 1, ""),
    (3, 0, "It fell BECAUSE it was old, because of rain and due to the wind that blew from the north"), (3, 1, "no cause"),
]


def test_answers(spark):
    t = spark.createDataFrame(SENTENCES, "doc_id long, sent_idx int, sentence string")
    assert sorted(map(tuple, answers.quantities(t).collect())) == [(1, 0, "ten 20 ten", 3, "Hypothesis"), (1, 1, "7", 1, "Certificate")]
    text = SENTENCES[5][2]
    assert sorted(map(tuple, answers.causes(t).collect())) == [
        (3, 0, "because", 9, text[8 : 8 + 7 + 50], "Certificate"), (3, 0, "due to", text.index("due to") + 1, text[text.index("due to") :][: 6 + 50], "Certificate"),
    ]
    assert answers.quantities(t.where("false")).count() == answers.causes(t.where("false")).count() == 0
