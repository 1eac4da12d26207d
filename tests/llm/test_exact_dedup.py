from collections import defaultdict

from pyspark.sql import functions as F

from factloom.llm import exact_dedup

ROWS = [(1, "Ab c"), (2, "aB C"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (8, "X"), (None, "ab c"), (9, "ab c "), (10, "w" * 200_000), (11, "W" * 200_000)]


def brute(rows):
    groups = defaultdict(list)
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    for i, t in rows:
        groups[fold(t)].append(i)
    return sorted((i is None, i or 0, len(groups[fold(t)]), max((x for x in groups[fold(t)] if x is not None), default=None)) for i, t in rows)


def check(docs, **options):
    found = exact_dedup.find_copies(docs, **options).collect()
    assert sorted((r.id is None, r.id or 0, r.group_size, r.keep_id) for r in found) == brute(ROWS)
    assert sum(r.kept for r in found) == 7
    return found


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    check(docs.repartition(3))


def test_state_goes_on_over_batches(spark):
    check(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5), files_per_batch=1)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = check(docs, digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0))
    assert len({bytes(r.digest) for r in found}) == 1


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(i, t, "s", n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, kept string, locator int")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 8, 9, 11]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_a_second_run_meets_the_first(spark, tmp_path):
    """Also with digests that collide, where the earlier rows' texts tell."""
    one = spark.createDataFrame([(5, "Ab c"), (9, "z"), (1, None)], "doc_id long, text string")
    two = spark.createDataFrame([(3, "aB C"), (12, "Z"), (4, "new")], "doc_id long, text string")
    for k, digest in enumerate((exact_dedup.sha256, lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0))):
        path = f"file://{tmp_path}/{k}"
        first = exact_dedup.find_copies(one, digest=digest, state_path=path)
        assert {(r.id, r.keep_id, r.group_size) for r in first.collect()} == {(5, 5, 1), (9, 9, 1), (1, 1, 1)}
        if k == 0:
            found = exact_dedup.find_copies(two, digest=digest, state_path=path, earlier=one).collect()
            assert {(r.id, r.keep_id, r.group_size, r.kept) for r in found} == {(3, 5, 2, False), (12, 12, 2, True), (4, 4, 1, True)}


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(7, "x", n, {"a": n}) for n in (3, 1, 2)] + [(8, "y", 5, None), (6, "X", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __name_id int, extra map<string,int>").repartition(3)
    for _ in range(2):
        assert sorted((r[0], r[2]) for r in exact_dedup.drop_copies(docs).collect()) == [(7, 1), (8, 5)]


def test_long_texts_and_many_batches(spark):
    docs = spark.createDataFrame(ROWS * 3, "doc_id long, text string").repartition(6)
    found = exact_dedup.find_copies(docs, files_per_batch=2).collect()
    assert sum(r.kept for r in found) == 7 and {r.group_size for r in found if r.id == 10} == {6}
