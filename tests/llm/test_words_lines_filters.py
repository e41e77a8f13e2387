import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from dishrank.llm import filter_audit, line_dedup, queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants_of(counts, ratio=5):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def collected(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


# Spelling variants.


def test_scan_finds_the_pairs_one_edit_apart():
    words = sorted({f"{a}{b}{c}" for a in ("", "a", "ab", "ba") for b in ("x", "xy", "yx", "é") for c in ("", "q", "qq", "漢")})
    every = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_apart(words[i], words[j])]
    assert list(spelling.near_pairs(words)) == every
    assert list(spelling.near_pairs([])) == list(spelling.near_pairs(["one"])) == []


def test_scan_skips_ranges_and_shares_rows(monkeypatch):
    built = []
    row = spelling._row
    monkeypatch.setattr(spelling, "_row", lambda *a: built.append(1) or row(*a))
    words = sorted(f"{head}{tail:04d}" for head in ("stem", "root", "leaf") for tail in range(300))
    pairs = list(spelling.near_pairs(words))
    assert len(pairs) == sum(one_apart(a, b) for i, a in enumerate(words) for b in words[i + 1:])
    # Far fewer rows than code points of all pairs: under a twentieth.
    assert len(built) * 20 < 8 * len(words) * (len(words) - 1) / 2


@pytest.mark.parametrize("most", [2, 8, 256])
def test_variants_equal_brute_force_however_groups_are_halved(spark, most):
    import random

    rng = random.Random(most)
    stems = ["".join(rng.choices("abcdeé", k=rng.randint(1, 14))) for _ in range(40)] + ["x" * 300, "prefixed" * 3]
    counts = {}
    for stem in stems:
        counts[stem] = rng.choice([5, 40, 1000])
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(stem))
            made = rng.choice([stem[:at] + stem[at + 1:], stem[:at] + "f" + stem[at:], stem[:at] + "b" + stem[at + 1:]])
            if made:
                counts.setdefault(made, rng.choice([5, 5, 8, 40, 200]))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.variant_groups(frame, most=most), *VARIANT) == variants_of(counts)


def test_a_group_of_a_third_of_all_words_is_halved_until_small(spark):
    words = spark.range(3000).select(F.concat(F.lit("prefix"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("word"), F.lit(5).cast("long").alias("n"))
    groups = spelling.grouped(words, most=64)
    # What cannot be halved leaves one code point open, two of the longer words.
    assert groups.groupBy("key").count().agg(F.max("count")).first()[0] <= 10 * 10
    near = spelling.near_words(words, most=64)
    # Each word has nine near words for every digit whose replacement is in the list.
    names = {f"prefix{i:04d}" for i in range(3000)}
    expected = sum(1 for w in names for p in range(6, 10) for d in "0123456789" if d != w[p] and w[:p] + d + w[p + 1:] in names)
    assert near.count() == expected == near.distinct().count()


def words_of(pairs):
    counts = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOW)
            h = crc32(f"{'' if i is None else i}:{low}".encode())
            counts[low[:h % len(low)] + low[h % len(low) + 1:] if h % 199 == 0 else low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_variants_of_texts(spark, docs_of, odd_texts, monkeypatch, tmp_path):
    import random

    rng = random.Random(3)
    vocabulary = ["Wonderful", "wonderfl", "Straße", "strase", "éclairs", "ÉCLAIRS", "eclairs", "mountain", "mountains", "short", "ab"]
    pairs = odd_texts + [(100 + k, " ".join(rng.choices(vocabulary, weights=[30, 1, 20, 2, 9, 2, 1, 40, 5, 9, 9], k=90))) for k in range(80)]
    counts = words_of(pairs)
    monkeypatch.setattr(queries, "table", lambda *a: docs_of(pairs))
    got = collected(queries.op11_spelling_variants(spark, ""), *VARIANT)
    assert got == variants_of(counts) and any(row[1] for row in got)


def test_long_texts_are_cut_between_runs_only(spark, docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    texts = [(1, "abc defgh 漢字 ijklmnopqrstu v  wé\nx" * 5), (2, ""), (3, None), (4, "a" * 50), (5, "123 456 789 012")]
    got = collected(spelling.runs(docs_of(texts)), "id", "run")
    assert got == sorted(((i, r) for i, t in texts for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")), key=str)


def test_variants_of_nothing(spark, docs_of):
    empty = spelling.vocabulary(spelling.runs(docs_of([])).withColumnRenamed("run", "word"))
    assert spelling.variant_groups(empty).collect() == []


# Line dedup.


def lines_left(rows, least=5, length=40):
    def key(line):
        return line.strip(SPACE).translate(LOW)

    holders = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(i)
    frequent = {k: max(ids) for k, ids in holders.items() if len(k) >= length and len(ids) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or frequent.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_texts():
    common, other = "The same line of more than forty letters, É and all.", "x" * 39
    return [
        (1, f"{common}\nfirst\n{common}"), (2, f"  {common.translate(LOW)} \t\nsecond\r"), (3, f"{common}\n"), (4, f"\n{common}"),
        (5, common), (5, common), (6, f"{common.replace('É', 'é')}\nsixth"), (9, f"{common}\nkeeper\n {common} "), (None, common),
        *[(20 + k, f"{other}\n{'y' * 40}\n{other}") for k in range(4)], (30, "y" * 39 + "é"), (31, "Y" * 40), (32, ""),
    ]


def test_frequent_lines_go_but_for_the_largest_id(docs_of, odd_texts):
    rows = line_texts() + odd_texts
    got = collected(line_dedup.drop_frequent(docs_of(rows)), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == lines_left(rows)
    assert any(r[2] for r in got)


def test_lines_of_many_documents_and_copies(docs_of):
    import random

    rng = random.Random(7)
    pool = [f"line number {k} that is well over forty code points long" for k in range(30)]
    rows = [(rng.randint(1, 60), "\n".join(rng.choices(pool, k=rng.randint(1, 40)) + [f"own {k}"])) for k in range(90)]
    rows += [(7, "same\n" + pool[0])] * 30
    got = collected(line_dedup.drop_frequent(docs_of(rows), least_documents=3), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == lines_left(rows, least=3)


def test_lines_keep_other_columns_and_take_nothing(docs_of):
    kept = line_dedup.drop_frequent(docs_of(line_texts()), keep=["source", "bucket", "doc_id"])
    assert kept.columns == ["doc_id", "n_lines", "n_dropped", "kept_text", "source", "bucket"]
    assert kept.where("bucket <> 'x'").isEmpty()
    assert line_dedup.drop_frequent(docs_of([])).collect() == []
    assert collected(line_dedup.drop_frequent(docs_of([(1, None)])), "doc_id", "n_lines", "n_dropped", "kept_text") == [(1, 1, 0, "")]


# Filter audit.


def test_merges_of_posting_lists():
    lists = [[1, 2, 3, 50, 51, 52], [3, 4, 60], [], [2, 3, 60, 61, 62, 63, 64, 65]]
    assert filter_audit.union(lists) == sorted({x for ids in lists for x in ids})
    assert filter_audit.union([]) == [] and filter_audit.union([[5]]) == [5] and filter_audit.union([[5], [5], [5]]) == [5]
    assert filter_audit.beyond(lists[0], lists[1]) == 5
    assert filter_audit.beyond([], [1]) == 0 and filter_audit.beyond([1, 2], []) == 2 and filter_audit.beyond([4], [4]) == 0


def test_runs_are_found_by_doubling_steps():
    class Counted(list):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return list.__getitem__(self, at)

    long = Counted(range(0, 200_000, 2))
    assert filter_audit.reach(long, 150_001, 0) == 75_001 and Counted.reads < 60
    assert filter_audit.reach(long, -5, 0) == 0 and filter_audit.reach(long, 10**9, 3) == len(long)


def audited(rows, labels):
    """``rows`` of (id, text, part)."""
    good, toxic = ({i for i, *held in labels if i is not None and held[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        parts[part or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, held in parts.items():
        removed, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = held
            for step, x in enumerate(order, 1):
                failing = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed[x] += len(failing)
                steps.append((
                    "".join(order), step, x, len(left), len(failing), sum(x in d[0] for d in held) - len(failing),
                    sum(d[0] == {x} for d in held), sum(d[1] for d in failing), sum(d[2] for d in failing),
                ))
        out += [(part, o, s, *rest, removed[x]) for o, s, x, *rest in steps]
    return sorted(out, key=str)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("bits, broadcast", [(2, 0), (16, 200_000)])
def test_audit_equals_counting_every_document(spark, docs_of, odd_texts, monkeypatch, bits, broadcast):
    import random

    monkeypatch.setattr(filter_audit, "RANGE_BITS", bits)
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", broadcast)
    rng = random.Random(bits)
    words = [f"word{k}" for k in range(200)] + ["UPPER", "$5"]
    texts = [" ".join(rng.choices(words[:rng.choice([20, 200, 202])], k=rng.choice([10, 60, 80]))) for _ in range(40)]
    pairs = odd_texts + [(rng.randint(1, 90), rng.choice(texts)) for _ in range(120)]
    docs = docs_of(pairs).withColumn("source", F.when(F.crc32("text") % 3 == 0, F.lit("a")).when(F.crc32("text") % 3 == 1, F.lit("b")))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(k, k % 2, k % 3 == 0) for k in range(1, 60)] + [(3, None, 1), (None, 1, 1), (5, 1, None), (5, 0, 1)]
    marked = [(i, q if q is None else int(q), t if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame(marked, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert collected(filter_audit.audit(docs, frame), *AUDIT) == audited(rows, marked)


def test_audit_of_nothing_and_of_clean_documents(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs_of([]), none).collect() == []
    clean = " ".join(f"w{k}" for k in range(60))
    got = collected(filter_audit.audit(docs_of([(1, clean), (1, clean)]).withColumn("source", F.lit(None).cast("string")), none), *AUDIT)
    assert len(got) == 600 and {r[3:] for r in got} == {(2, 0, 0, 0, 0, 0, 0)} and {r[0] for r in got} == {""}
