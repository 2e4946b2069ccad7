"""The pipeline's stages on rows whose id or source is null, empty or occurs again."""

from collections import Counter

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(a, n=40):
    return " ".join(f"w{a}x{i}" for i in range(n))


def made(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3)


def kept(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_mixture_keeps_null_and_repeated_ids_and_sources(spark, sf):
    rows = [(None, words(1), "a"), (None, words(1), "a"), (None, None, None), (None, words(2), ""), (None, words(3), None)]
    rows += [(7, words(4), None), (7, words(4), ""), (7, words(5), "a"), (7, words(5), "a"), (8, "", "a"), (9, None, "b")]
    assert kept(pipeline.mixture(spark, made(spark, rows), sf)) == Counter(rows)


def test_mixture_is_in_the_order_of_the_schedule(spark, sf):
    rows = [(i if i % 3 else None, words(i), "a" if i % 2 else None) for i in range(64)]
    out = [r.source for r in pipeline.mixture(spark, made(spark, rows), sf).collect()]
    assert [out[i : i + 16] for i in range(0, 64, 16)] in ([["a"] * 16, [None] * 16] * 2, [[None] * 16, ["a"] * 16] * 2)


def test_near_duplicates_of_null_and_repeated_ids(spark, sf):
    rows = [(None, words(1), "a"), (None, words(1), "b"), (None, words(1), "b")]  # one of three stays
    rows += [(None, words(2), "a"), (4, words(2), "a"), (6, words(2), "a")]  # 4 stays
    rows += [(5, words(3), "a"), (5, words(3), "a")]  # one of two stays
    rows += [(8, words(4), "a"), (8, words(5), "a"), (3, words(5), "a")]  # 3 and the other text of 8 stay
    rows += [(None, "few", "a"), (None, "few", "a"), (9, "few", "a")]  # 9 stays
    rows += [(None, None, "a"), (None, None, "a"), (2, "", "a"), (2, " ", "a")]  # no shingles, so no duplicates
    out = kept(pipeline.near_duplicates(spark, made(spark, rows), sf))
    first = [k for k in out if k[1] == words(1)]
    assert len(first) == 1 and out.pop(first[0]) == 1
    assert out == Counter([(4, words(2), "a"), (5, words(3), "a"), (8, words(4), "a"), (3, words(5), "a"), (9, "few", "a"), *rows[-4:]])


def test_stages_keep_rows_without_ids(spark, sf):
    rows = [(None, words(i), "" if i % 2 else None) for i in range(8)] + [(7, words(9), "a"), (7, words(10), "a")]
    docs = made(spark, rows)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == len(rows), name
