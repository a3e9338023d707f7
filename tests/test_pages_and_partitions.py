"""Pages by directory and filtered search by partition pruning, against the plain forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import catalog as C
from larder.operators import page_directory as P
from larder.operators import vectors as V

KEYS = [("kind", True), ("price", False), ("id", True)]


@pytest.fixture(scope="module")
def goods(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None, "é"]), rnd.choice([1.5, 2.0, 2.0, None]), f"n{i}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, kind string, price double, name string").repartition(4).cache()


def test_pages_by_directory_equal_offset_paging(spark, goods, scratch):
    P.write_page_directory(goods, scratch, KEYS, rows_per_part=250)
    order = [F.asc("kind"), F.desc("price"), F.asc("id")]
    for page, size in ((1, 10), (2, 10), (30, 100), (31, 100), (151, 20), (9, 333), (1, 5000), (2, 5000)):
        want = list(map(tuple, C.paginate(goods, order=order, page=page, size=size).collect()))
        assert list(map(tuple, P.read_page(spark, scratch, KEYS, page=page, size=size).collect())) == want, (page, size)


def test_a_deep_page_reads_only_its_partitions(spark, goods, scratch):
    P.write_page_directory(goods, scratch, KEYS, rows_per_part=250)
    sizes = {r[P.PART]: r["n"] for r in spark.read.parquet(f"{scratch}/directory").collect()}
    assert len(sizes) >= 10 and max(sizes.values()) < 1000 and sum(sizes.values()) == 3000
    page = P.read_page(spark, scratch, KEYS, page=150, size=20)
    wanted = {p for p, _ in P.page_parts(spark, scratch, page=150, size=20)}
    assert 1 <= len(wanted) <= 2
    read = {f.rsplit(f"{P.PART}=", 1)[1].split("/")[0] for f in page.inputFiles() if f"{P.PART}=" in f}
    assert read == {str(p) for p in wanted}


def test_pages_of_an_empty_table(spark, goods, scratch):
    P.write_page_directory(goods.limit(0), scratch, KEYS)
    page = P.read_page(spark, scratch, KEYS, page=1, size=10)
    assert page.collect() == [] and set(goods.columns) < set(page.columns)
    with pytest.raises(ValueError):
        P.read_page(spark, scratch, KEYS, page=0, size=10)


def test_filtered_search_reads_only_the_asked_partitions(spark, scratch):
    rnd = random.Random(6)
    vec = lambda: [rnd.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(6)]
    coll = spark.createDataFrame([(i, vec(), f"c{i % 7}" if i % 50 else None, 1) for i in range(900)], "vec_id long, embedding array<double>, category string, _nb int").cache()
    path = os.path.join(scratch, "vectors")
    V.vector_collection_write(coll, path, partition_by="category")
    asked = [(i, vec(), f"c{1 + i % 2}") for i in range(20)] + [(50, vec(), "unknown")]
    queries = lambda extra: spark.createDataFrame(asked + extra, "query_id long, embedding array<double>, wanted string")
    plain = lambda q: sorted(map(tuple, V.vector_top_k(q, coll, k=7, filter_col="category", query_filter_col="wanted").collect()))
    by = lambda q, **kw: V.vector_top_k_partitioned(q, path, k=7, filter_col="category", query_filter_col="wanted", **kw)
    # a query without a filter meets all, also the vectors without a category
    free = queries([(60, vec(), None)])
    assert sorted(map(tuple, by(free).collect())) == plain(free)
    for kw in ({}, {"block_rows": 3, "chunk_rows": 40}):
        assert sorted(map(tuple, by(queries([]), **kw).collect())) == plain(queries([]))
    # folders that nobody asks for are not even opened: their files are no Parquet files
    for value in ("c3", "c4", "c6"):
        folder = os.path.join(path, f"category={value}")
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                crc = os.path.join(folder, f".{name}.crc")
                open(os.path.join(folder, name), "wb").write(b"no parquet file")
                open(crc, "wb").close() if os.path.exists(crc) else None
    spark.catalog.clearCache()
    hits = by(queries([]))
    assert "dynamicpruning" in hits._jdf.queryExecution().toString()
    assert {r["query_id"] for r in hits.collect()} == set(range(20))
