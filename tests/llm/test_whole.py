"""Text that shows its wrong decoding without a letter."""

import math

from tonegrid.llm import mojibake


def test_controls_are_reported(spark):
    rows = [(i, "The court held that the claim, as filed, was well founded – and so ordered.", "s") for i in range(50)]
    rows += [(100, "The court held \x96 by order \x96 that it paid \x80 40.", "s"), (101, "Nothing but plain words – and a dash.", "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mojibake.repair(d).collect()}
    assert set(got) == {100}


def test_symbols_count_where_their_cipher_is_frequent():
    cipher = ("cp1251", "cp1252")
    pairs = {"0 ": 500.0, " €": 500.0, "€ ": 500.0, "€.": 200.0, " ˆ": 0.01}
    for share, found in ((0.2, True), (0.0, False)):
        priors = {"<".join(cipher): math.log(1000 * share / 1001)} if share else {}
        got = mojibake.Reader(pairs).document(priors, "It paid 100 ˆ and 200 ˆ.")
        assert (got is not None) == found
        assert not found or got[1] == "It paid 100 € and 200 €."
