import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from dishrank.llm import ann, exact_search, pii, warc
from dishrank.llm.packing import word_tokenizer
from dishrank.llm.queries import oracle_sql, queries

from .conftest import DATA
from .test_sets_and_windows import groups_of, windows_left


@pytest.fixture(scope="module")
def vectors_of(spark):
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()), T.StructField("block", T.StringType()), T.StructField("dim", T.StringType()),
    ])
    return lambda rows: spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], schema)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(900 + i, rows[i][1]) for i in range(40)]  # equal vectors
    rows += [
        (2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [float("inf")] * 8),
        (2500, [None] + [1.0] * 7), (2600, [1.0, 2.0]), (2700, [2.0, 1.0]), (None, [1.0] * 8), (100, rows[100][1]),
    ]
    return rows


def usable(rows, zero=True):
    return [
        (i, np.array(v, dtype=np.float64)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v))
    ]


def expected_top(rows, k, every, scale=None):
    out = []
    rows = [(i, np.floor(v * scale) if scale else v) for i, v in rows]
    for q, v in (r for r in rows if r[0] % every == 0):
        scores = sorted((-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_exact_search_matches_brute_force(vectors_of):
    rows = odd_vectors()
    got = exact_search.exact_top_k(vectors_of(rows), k=10, every=100)
    expected = expected_top(usable(rows), 10, 100, 1024)
    assert sorted(map(tuple, got.collect())) == [(q, n, i, int(s)) for q, n, i, s in expected]


def test_exact_search_over_many_shards(vectors_of):
    rows = odd_vectors()
    frame = vectors_of(rows).where("vec_id is not null and size(embedding) = 8 and vec_id < 1000").select(
        F.col("vec_id").alias("id"), exact_search.scaled(F.col("embedding"), 1024).alias("vector")
    )
    got = exact_search.top_k(frame.where("id % 50 = 0"), frame, 5, shard=64).collect()
    kept = [(i, v) for i, v in usable(rows) if i < 1000]
    assert sorted(map(tuple, got)) == expected_top(kept, 5, 50, 1024)


def test_dual_search_prunes_far_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 1000
    points = np.concatenate([c + rng.normal(size=(200, 6)) for c in centres])
    queries = points[:50] + 0.5
    search = exact_search.DualSearch(queries, np.arange(50) + 10_000, points, np.arange(len(points)), 3)
    search.run(exact_search.cover_tree(queries, 16), exact_search.cover_tree(points, 64))
    best = np.sort(queries @ points.T, axis=1)[:, ::-1][:, :3]
    assert np.allclose(search.scores, best) and search.pairs < 0.5 * len(queries) * len(points)


def test_written_trees_are_the_trees(vectors_of):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(700, 4)), np.ones((50, 4)), rng.normal(size=(300, 4)) + 40])
    tree = exact_search.cover_tree(points, leaf=16)
    again = exact_search.unpacked_tree(*exact_search.packed_tree(tree, points), points)

    def same(a, b):
        assert sorted(a.members) == sorted(b.members) and a.radius == b.radius and (a.centre == b.centre).all()
        assert len(a.children) == len(b.children)
        for x, y in zip(a.children, b.children):
            same(x, y)

    same(tree, again)
    assert len(tree.children) > 1


def test_rows_of_one_id_are_dealt_to_many_blocks(vectors_of):
    rng = np.random.default_rng(6)
    rows = [(100, [1.0, 2.0])] * 300 + [(i, rng.normal(size=2).tolist()) for i in range(300)]
    frame = vectors_of(rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    sizes = [len(r.ids) // 8 for r in exact_search.blocks(exact_search.placed(frame), 50).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 110
    got = exact_search.exact_top_k(vectors_of(rows), k=5, every=100)
    assert sorted(map(tuple, got.collect())) == [(q, n, i, int(s)) for q, n, i, s in expected_top(usable(rows), 5, 100, 1024)]


def test_neighbours_are_found(spark):
    data = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = ann.nearest(data, k=20, every=20).collect()
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in data.collect()]
    expected = expected_top(rows, 20, 20)
    assert len(got) == len(expected)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in expected}
    assert len(hit) >= 0.9 * len(expected)
    exact = dict(rows)
    assert all(abs(r.score - exact[r.query_id] @ exact[r.vec_id]) < 1e-12 for r in got)


def test_neighbours_of_odd_rows(vectors_of):
    rows = odd_vectors()
    got = ann.nearest(vectors_of(rows), k=20, every=20).collect()
    expected = expected_top(usable(rows, zero=False), 20, 20)
    assert {r.query_id for r in got} == {q for q, *_ in expected} and len(got) == len(expected)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in expected}
    assert len(hit) >= 0.9 * len({(q, i) for q, _, i, _ in expected})


@pytest.mark.parametrize("dim", [8, 64])
def test_neighbours_among_many_equal_vectors(vectors_of, dim):
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(900, dim))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    unit[::3] = unit[0]
    unit[1::90] = unit[1]
    rows = [(i, v.tolist()) for i, v in enumerate(unit)] + [(0, unit[0].tolist()), (3, unit[5].tolist())]
    zeros = unit[7].copy()
    zeros[0] = 0.0
    rows += [(2000, zeros.tolist()), (2001, [-0.0, *zeros.tolist()[1:]])]
    got = ann.nearest(vectors_of(rows), k=20, every=20).collect()
    expected = expected_top(usable(rows), 20, 20)
    assert len(got) == len(expected)
    # Queries that have copies find these in the order of their ids.
    first = {(r.query_id, r.rank): r.vec_id for r in got}
    copies = sorted([0, *range(0, 900, 3)])
    for q in range(60, 900, 60):
        assert [first[q, n + 1] for n in range(20)] == [i for i in copies if i != q][:20]
    # Zeros of either sign are equal; so is the score of the vector that they were made of.
    assert (first[2000, 1], first[2000, 2]) == (7, 2001)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in expected}
    assert len(hit) >= 0.95 * len({(q, i) for q, _, i, _ in expected})


def test_no_vectors(vectors_of):
    assert exact_search.exact_top_k(vectors_of([]), 10, 100).count() == 0
    assert ann.nearest(vectors_of([]), 20, 20).count() == 0


# Archives.


@pytest.fixture(scope="module")
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "k", "c") for r in rows], "page_id long, url string, html string, key string, content string")


def odd_pages():
    same, small = "<p>" + "é" * 200 + "</p>", "tiny"
    return [
        (5, "http://a.b.c:8080/x?y=1#z", same), (3, "HTTPS://User@A.b.C/x", same), (9, None, same), (9, None, same),
        (4, "", small), (6, "no scheme/päth\twith\ntabs", small), (7, "http://b", None), (8, "http://b", ""),
        (None, "http://null.id/", same), (10, "http://long/", "x" * 300_000), (11, "http://a.b.c/", "\r\n\r\nWARC/1.1\r\n" * 20),
        (12, "http://a.b.c/", "\r\n\r\nWARC/1.1\r\n" * 20),
    ]


def expected_records(pages):
    first = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        answer = first.get(data)
        revisit = answer is not None and answer != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", answer if revisit else None))
    return sorted(out, key=str)


def test_pages_come_back_from_the_archives(pages_of):
    got = warc.round_trip(pages_of(odd_pages()).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == expected_records(odd_pages())
    assert warc.round_trip(pages_of([])).count() == 0


def test_archives_are_plain_warc_files(pages_of):
    pages = pages_of(odd_pages()).select(F.col("page_id").alias("id"), "url", "html").coalesce(1)
    files = list(warc.archive_files(warc.write_archives(pages, size=2_000)))
    assert len(files) > 1
    text = b"".join(gzip.decompress(data) for _, data in files)
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_index_finds_single_keys(pages_of, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 10}.example.org/p{i}", f"page {i}") for i in range(200)]
    archives = warc.write_archives(pages_of(rows).select(F.col("page_id").alias("id"), "url", "html"))
    index = warc.write_index(archives)
    wanted = pages_of(rows).where("page_id in (0, 57, 199)")
    keys = wanted.select(warc.key_column(F.col("url"), F.col("page_id")).alias("key"))
    missing = keys.sparkSession.createDataFrame([("zz)/ 1",), ("",), (None,)], "key string")
    found = warc.read_records(warc.find(keys.union(missing), index), archives).collect()
    assert sorted(r.page_id for r in found) == [0, 57, 199]


def test_keys_sort_by_reversed_host():
    assert warc.surt("https://Blog.example.com:443/a?b#c") == "com,example,blog)/a?b"
    assert warc.surt("http://x.org:8080?q") == "org,x:8080)/?q"
    assert warc.surt(None) == ")/"


# The pipeline.


def test_pipeline_matches_plain_stages(spark, docs_of, near_copies, tmp_path):
    texts = [(i, t + " mail a.b@c.org") for i, t in near_copies if len(t) > 100] + [(5000, "1 2 3"), (5001, None), (5001, None)]
    docs_of(texts, lang="en").drop("id").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    known = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    first = {(i, g) for i, _, g in groups_of(known) if i == g}
    unique = [(i, t) for i, t in known if (i, i) in first]
    left = {r[0]: r for r in windows_left(unique)}
    tokens = word_tokenizer(__import__("public_tokenizers").path("word_bpe_49k.json")).tokenizer
    expected = {}
    for i, t in unique:
        _, words, gone, kept = left[i]
        if gone < max(words, 1):
            clean = pii.redacted(kept if gone else t)
            expected[i] = len(tokens.encode(clean, add_special_tokens=False).ids) + 1
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == expected


def test_pipeline_of_nothing(spark, docs_of, tmp_path):
    docs_of([]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_row_of_each_group_with_null_and_repeated_ids(spark, docs_of):
    base = [f"v{i}" for i in range(100)]
    near = lambda k: " ".join(base[:97] + [f"own{k}"] * 3)
    rows = [(None, near(k)) for k in range(5)] + [(None, near(0))] * 30 + [(7, near(9)), (7, near(10)), (7, near(10)), (8, near(0))]
    rows += [(None, "only rows without an id hold this text")] * 20 + [(9, "two texts"), (9, "of one id and no other group")]
    rows += [(None, None), (None, None), (11, " "), (11, " ")]
    out = corpus_pipeline.one_of_similar(spark, docs_of(rows), "").collect()
    got = sorted(((r.doc_id, r.text) for r in out if r.text != near(9) and r.text != near(10)), key=str)
    assert got == sorted([
        (None, "only rows without an id hold this text"), (9, "two texts"), (9, "of one id and no other group"),
        (None, None), (None, None), (11, " "),
    ], key=str)
    assert [r.doc_id for r in out if r.text in (near(9), near(10))] == [7]


def test_letter_junk_and_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = np.random.default_rng(4)

    def junk(words):
        return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(words))

    polish = (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
        "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    )
    gone = [polish, junk(10), junk(30), junk(200), junk(500), "12 34", None]
    stay = ["the", "ok", "The cat", "This is the house of the man.", "le chat et la maison", "der Hund und die Katze"]
    rows = [(10_000_000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(gone + stay)]
    # Without a label, so that no row is learned from.
    extra = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], docs.schema)
    out = corpus_pipeline.known_language(spark, docs.union(extra), DATA)
    assert {r.text for r in out.where("doc_id >= 10000000").collect()} == set(stay)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert out.where("doc_id < 10000000").count() == lettered.count()


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert 0 < out.count() <= docs.count()


def test_every_operator_has_a_query():
    names = list(queries())
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and len(names) == 13
    assert set(oracle_sql()) <= set(names)
