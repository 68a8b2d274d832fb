"""Lines one insertion apart meet at every length."""

import random

from storyloom.llm.lines import line_dedup


def test_one_insertion_at_all_lengths(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    first, second = [], []
    for size in range(20, 801):
        line = "".join(draw.choice(letters) for _ in range(size))
        at = draw.randrange(size + 1)
        pair = [line, line[:at] + "0" + line[at:]]
        draw.shuffle(pair)
        first.append(pair[0])
        second.append(pair[1])
    docs = spark.createDataFrame([(1, "\n".join(first)), (2, "\n".join(second))], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup(docs).select("row.doc_id", "n_dropped", "text").collect()}
    assert got[1][0] == 0
    assert sorted(map(len, got[2][1].split("\n"))) == [0]
    assert got[2][0] == len(second)
