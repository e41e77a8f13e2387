import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from dishrank.llm import jaccard_join, substring_dedup
from dishrank.llm.components import components
from dishrank.llm.words import slices, window_hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    name = {k: k for k in range(len(sets))}

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = len(x & y)
            if sets[a][0] is not None and sets[b][0] is not None and same and 100 * same >= 80 * len(x | y):
                name[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(
        ((i, len(s), least[find(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str
    )


def windows_left(rows, width=13):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone.update(range(p, p + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("lower", [False, True])
def test_words_match_the_pattern(odd_texts, lower):
    texts = [t for _, t in odd_texts] + ["a", " b", "c ", "", "d\x0be\x1cf"]
    words = words_of(pa.array(texts, pa.string()), lower=lower)
    data = words.data.tobytes()
    got = [[] for _ in texts]
    for s, n, k in zip(words.starts, words.lengths, words.text_of):
        got[k].append(data[s:s + n].decode())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == [WORD.findall((t or "").translate(low) if lower else t or "") for t in texts]
    assert [len(g) for g in got] == words.per_text.tolist()


def test_equal_windows_have_equal_hashes_wherever_they_are():
    words = words_of(pa.array(["a b c d e", "x a b c", None, "ab c", "a b"]))
    hashes, first = window_hashes(words, 3)
    spelled = {}
    data = words.data.tobytes()
    for h, f in zip(hashes, first):
        text = tuple(data[words.starts[f + k]:words.starts[f + k] + words.lengths[f + k]] for k in range(3))
        assert spelled.setdefault(int(h), text) == text
    assert len(hashes) == 5 and len(spelled) == 4


def test_slices_keep_all_rows_and_never_cut_a_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "b" * 5, "", "c" * 100, "d"])], names=["t"])
    parts = list(slices(batch, "t", limit=32))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert len(parts) == 4


def test_groups_match_brute_force(docs_of, near_copies):
    rows = near_copies
    got = as_rows(jaccard_join.similar_groups(docs_of(rows)), "doc_id", "n_shingles", "component_id")
    assert got == groups_of(rows)
    assert len({g for _, _, g in got}) < len(rows)


def test_groups_larger_than_the_common_count(docs_of):
    base = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(base[:90] + [f"own{i}"] * 2 if i % 2 else base)) for i in range(60)]
    assert as_rows(jaccard_join.similar_groups(docs_of(rows)), "doc_id", "n_shingles", "component_id") == groups_of(rows)


def test_chains_of_links_are_one_group(docs_of):
    base = [f"v{i}" for i in range(200)]
    rows = [(100 - k, " ".join(base[4 * k:4 * k + 60])) for k in range(30)]
    got = as_rows(jaccard_join.similar_groups(docs_of(rows)), "doc_id", "n_shingles", "component_id")
    assert got == groups_of(rows) and {g for _, _, g in got} == {71}


def test_groups_of_odd_rows(docs_of, odd_texts):
    rows = [r for r in odd_texts if r[0] != 6] + [(6, "four words of it"), (5, "another text of one id")]
    got = as_rows(jaccard_join.similar_groups(docs_of(rows)), "doc_id", "n_shingles", "component_id")
    assert got == groups_of(rows)


def test_groups_of_a_long_text(docs_of, odd_texts):
    long = dict(odd_texts)[6]
    rows = [(6, long), (3, long + " end")]
    got = as_rows(jaccard_join.similar_groups(docs_of(rows)), "doc_id", "n_shingles", "component_id")
    assert got == groups_of(rows) and {g for _, _, g in got} == {3}


def test_windows_match_brute_force(docs_of, near_copies, odd_texts):
    for rows in (near_copies, odd_texts, [(1, "a " * 40), (2, "a " * 15), (2, "b " + "a " * 20)]):
        got = as_rows(substring_dedup.remove_repeated(docs_of(rows)), "doc_id", "n_words", "n_removed", "kept_text")
        assert got == windows_left(rows)


def test_null_and_repeated_ids_are_in_no_single_task(spark, docs_of, near_copies, monkeypatch):
    plain_cut = substring_dedup._cut

    def counted(width, untouched):
        run = plain_cut(width, untouched)

        def cut(texts, replies):
            out = run(texts, replies)
            # Carries the number of rows of one call out in the place of a count of words.
            return out.set_column(1, "n_words", pa.array([texts.num_rows] * out.num_rows, pa.int64()))

        return cut

    passage = " ".join(f"p{i}" for i in range(30))
    hot = [(500, f"own{i} {passage} and {i}") for i in range(300)] + [(500, passage)] * 100
    rows = near_copies + hot + [(None, t) for _, t in hot] + [(3, passage + " more")]
    monkeypatch.setattr(substring_dedup, "HEAVY_BYTES", 5_000)
    monkeypatch.setattr(substring_dedup, "SALTED_ROWS", 10)
    docs = docs_of(rows)
    got = as_rows(substring_dedup.remove_repeated(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == windows_left(rows)
    monkeypatch.setattr(substring_dedup, "_cut", counted)
    monkeypatch.setattr(substring_dedup, "partitions_for", lambda *a: 40)
    held = substring_dedup.remove_repeated(docs.where("doc_id is not null"))
    most = held.agg({"n_words": "max"}).first()[0]
    assert most < len(hot) / 2


def test_windows_keep_named_columns_and_untouched_texts(docs_of):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"first\n {passage}"), (2, f"{passage} then\nmore"), (3, "nothing\n  shared")]
    out = substring_dedup.remove_repeated(docs_of(rows), keep=("source", "n_chars"), untouched=True)
    assert as_rows(out, "doc_id", "kept_text", "n_chars") == [
        (1, f"first\n {passage}", len(rows[0][1])), (2, "then more", len(rows[1][1])), (3, "nothing\n  shared", 16)
    ]


def test_empty_tables(docs_of):
    assert jaccard_join.similar_groups(docs_of([])).count() == 0
    assert substring_dedup.remove_repeated(docs_of([])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 110)] + [(200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in range(100, 110)} == {100} and got[201] == 200


def test_digest_of_the_kept_text(spark, docs_of):
    text = "é b  c"
    row = substring_dedup.remove_repeated(docs_of([(1, text)])).first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == hashlib.sha256("é b c".encode()).hexdigest()
    assert np.array_equal([row.n_words, row.n_removed], [3, 0])
