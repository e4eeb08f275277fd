"""Section paths by hand, and time that grows with the text alone."""

import time

from tessera.operators import chunks as K


def test_section_paths_by_hand():
    text = "intro\n# A\nx\n\n## B\ny\n### C\n\n\n\nz\n## D\n# E\n#no heading\n"
    got = [(text[a:b], t, p) for a, b, t, p in K.sections(text)]
    assert got == [
        ("intro\n", None, []),
        ("# A\nx\n\n", "A", ["A"]),
        ("## B\ny\n", "B", ["A", "B"]),
        ("### C\n\n", "C", ["A", "B", "C"]),
        ("\n\n", None, ["A", "B", "C"]),
        ("z\n", None, ["A", "B", "C"]),
        ("## D\n", "D", ["A", "D"]),
        ("# E\n#no heading\n", "E", ["E"]),
    ]
    assert K.sections("") == [] and K.sections("\n\n\n") == [(0, 2, None, []), (2, 3, None, [])] and K.sections("one") == [(0, 3, None, [])]
    assert [p for *_, p in K.sections("### C\n## B\n## D\n")] == [["C"], ["C", "B"], ["C", "D"]]  # places, not levels


def test_time_grows_with_the_text(spark):
    def seconds(n):
        text = "".join(f"## h{i}\nword word\n\n" for i in range(n))
        df = spark.createDataFrame([("s", text)], "id string, text string")
        start = time.time()
        rows = K.exploded(df, K.merge_small(K.general_spans(df.text), df.text, 3)).count()
        assert rows >= n / 2
        return time.time() - start

    seconds(400)
    assert seconds(64_000) < 20  # a square would take minutes
