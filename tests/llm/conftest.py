import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in "n r s t lo mi".split()]


@pytest.fixture(scope="session")
def corpus():
    """(id, text, source) rows with nulls, empty and very long texts, equal rows, equal ids, copies, near copies and shared passages."""
    rng = random.Random(5)

    def prose(n):
        out = []
        for k in range(n):
            w = rng.choice(WORDS) + rng.choice(WORDS)
            out.append((w.capitalize() if not k % 9 else w) + (".\n" if k % 9 == 8 else ""))
        return " ".join(out)

    passage, line = prose(60), "All rights reserved by the authors of this page.\n"
    rows = [(k, line * (k % 3 == 0) + prose(rng.randint(3, 150)) + (" " + passage if k % 4 == 0 else ""), f"s{k % 4}") for k in range(60)]
    long = prose(9000)
    rows += [(60, long, "s0"), (61, long.replace("ban", "x", 3), "s0"), (62, "é¡ 漢字 <|endoftext|> don't we'll \U0001F600" + passage, "s1")]
    for k in range(70, 85):  # near copies of one text
        words = rows[7][1].split(" ")
        words[k % len(words)] = f"changed{k}"
        rows.append((k, " ".join(words), "s0"))
    rows += [(k, rows[9][1].replace(" ", "\t\n"), "s0") for k in range(90, 110)]  # copies up to white space
    rows += [(200, None, None), (201, "", None), (202, " \n", "s1"), (203, "one", "s1"), (204, "one two", "s1"), (205, "two  one", "s1")]
    rows += [(206, "same row same text again and again", "s2")] * 3 + [(207, prose(40), "s2"), (207, prose(30), "s2"), (None, prose(20), "s3"), (None, None, None)]
    rows += [(208, "ababab" * 60, "s3"), (209, "ab" * 150, "s3")]
    return rows


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    shape = "doc_id bigint, text string, source string, lang string, n_chars bigint, id bigint, kept boolean, score double, `row` string, size bigint, bucket int, `a.b` string"
    return spark.createDataFrame([(i, t, s, None, None if t is None else len(t), 7, None, 0.5, "r", 3, 1, "x") for i, t, s in corpus], shape).repartition(3)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame.where("1 = 0")
