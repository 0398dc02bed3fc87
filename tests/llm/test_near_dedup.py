"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np

from gridwatch.llm import near_dedup as N
from gridwatch.llm.common import load

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                top[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = ids.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in N.near_dedup_query(df).collect()], key=str)


def test_words_are_split_as_stated():
    table = N.byte_table()
    for t in ["", " ", " a", "a ", "a b\tc\n\x0bd\x0c\re", "é à\xa0b \x1c x\x85y", "x" * 200 + " " + "x" * 199, "a" * 64 + "b", "ab " * 500]:
        assert len(N.word_hashes(t.encode(), table)) == len(words(t)), t
    assert len(set(N.word_hashes(b"ab ba abc a b aab aba", table).tolist())) == 7
    one, two = ("x" * 63 + "yz" + "x" * 70), ("x" * 63 + "zy" + "x" * 70)
    assert N.word_hashes(one.encode(), table)[0] != N.word_hashes(two.encode(), table)[0]


def test_coordinates_estimate_similarity():
    rng = np.random.default_rng(5)
    items = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    for shared in (300, 600, 900):
        a, b = items[:shared + (1500 - shared) // 2], np.concatenate([items[:shared], items[shared + (1500 - shared) // 2:]])
        want = shared / 1500
        got = np.mean(N.signature(a, 2048) == N.signature(b, 2048))
        assert abs(got - want) < 0.05


def variants(rng):
    """Groups of near copies in chains, shared passages, small sets at the threshold."""
    out = []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    for _ in range(6):
        w = rng.choices(vocabulary, k=rng.choice([12, 40, 90, 200]))
        for _ in range(rng.choice([2, 5, 12])):
            out.append(" ".join(w))
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
    for _ in range(40):
        out.append(passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([2, 6, 10, 14, 30]))))
    for n in (5, 6, 7, 8, 9, 10, 11, 12):
        out += [" ".join(vocabulary[:n]), " ".join(vocabulary[:n]).upper()]
    return out


def test_small_cases(spark):
    rng = random.Random(11)
    texts = variants(rng) + [None, "", "  \n", "a", "A", "a b", "a b c d", "A B C D", "x " * 40000, "X " * 30000, "a\xa0b", "a b\xa0"]
    rng.shuffle(texts)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, "null id alone here now ok"), (7, "a b"), (7, "a b"), (7, "other text")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, cls string")
    assert result(df.repartition(4)) == brute(rows)


def test_one_large_group(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(100)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sieve_keeps_wanted_rows_and_few_others(spark):
    rows = spark.range(40000).selectExpr("if(id = 0, null, id * id) as doc_id", "id as n")
    wanted = rows.filter("n % 40 = 0").select("doc_id")
    left = [r.n for r in N.sieved(rows, "doc_id", wanted).select("n").collect()]
    assert set(range(0, 40000, 40)) <= set(left) and len(left) == len(set(left)) < 1000 + 0.06 * 39000
    assert N.sieved(rows, "doc_id", wanted.limit(0)).count() == 0


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "SLOT_BITS", 3)
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    assert {r.doc_id for r in N.sieved(rows, "doc_id", rows.filter("doc_id % 3 = 0")).collect()} >= set(range(0, 2000, 3))
    test_small_cases(spark)


def test_prefix_join_lists_every_pair_in_narrow_rows(spark):
    rng = random.Random(8)
    sets = {}
    for g in range(12):
        base = rng.sample(range(10**9), 400)
        for _ in range(5):
            own = list(base)
            for _ in range(rng.choice([0, 5, 30, 55, 120])):
                own[rng.randrange(400)] = rng.randrange(10**9)
            sets[len(sets)] = set(own)
    labels = {c: c - c % rng.choice([1, 5]) for c in sets}
    table = spark.createDataFrame([(c, len(x), [], sorted(x)) for c, x in sets.items()], "cls long, n long, bits array<long>, items array<long>")
    members = spark.createDataFrame(list(labels.items()), "cls long, label long")
    rows = N.prefix_rows(members, table)
    arrays = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    assert rows.count() > 2000 and max(len(r[c]) for r in rows.select(*arrays).collect() for c in arrays) == N.BEFORE
    got = [tuple(r) for r in N.prefix_pairs(members, table).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b]
            and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and len(want) > 20 and want <= set(got)


def test_empty_table(spark):
    assert N.near_dedup_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    df = load(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert any(not r[3] for r in want) and result(df) == want
