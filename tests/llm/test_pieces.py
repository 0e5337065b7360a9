import random

import brute

from lumidex.llm import ibf


def test_an_edit_of_the_last_quarter_leaves_the_rest_alike(spark):
    """One-line texts without an ASCII sentence end, with marks of another script, without spaces, and a short one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 9)))
    glyph = lambda: chr(rng.randrange(0x4E00, 0x9000))
    texts = [
        " ".join(word() for _ in range(2500)),
        "".join("".join(glyph() for _ in range(30)) + "。" for _ in range(60)),
        "".join(glyph() for _ in range(2000)),
        " ".join(word() for _ in range(40)) + ".",
    ]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], brute.SCHEMA)
    rows = {r.doc_id: r for r in ibf.version_report(df).collect()}
    assert all(r.near_next == 0 for r in rows.values())
    assert rows[0].near_edited > 0.5 and rows[1].near_edited > 0.5 and rows[2].near_edited > 0.4 and rows[3].near_edited > 0.2
