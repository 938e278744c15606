"""String tiling and SimHash groups against brute force, planted cases and awkward rows."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tablesmith.llm import components, decontam, simhash


def brute_tiles(a, b, least):
    """Mark the longest common run of unmarked tokens again and again."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    least = min(least, len(a))
    while least:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            break
        fa[i : i + n] = [False] * n
        fb[j : j + n] = [False] * n
        out.append(n)
    return out


def test_tiles_cover_as_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 14))]
        b = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 40))]
        got = decontam.tile(a, b, 3)
        assert [n for *_, n in got][:1] == brute_tiles(a, b, 3)[:1]
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        for side in (0, 1):
            used = [x for t in got for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        # nothing as long as the least length is left on both sides
        left_a, left_b = set(range(len(a))) - {x for i, _, n in got for x in range(i, i + n)}, set(range(len(b))) - {x for _, j, n in got for x in range(j, j + n)}
        k = min(3, len(a))
        if k:
            runs = lambda s, free: {tuple(s[i : i + k]) for i in range(len(s) - k + 1) if all(i + d in free for d in range(k))}
            assert not runs(a, left_a) & runs(b, left_b)


def test_tiles_of_a_long_run():
    a = [b"%d" % i for i in range(300)]
    assert decontam.tile(a, [b"x", *a, b"y"]) == [(0, 1, 300)]
    assert sorted(decontam.tile(a, a[150:] + a[:150])) == [(0, 150, 150), (150, 0, 150)]


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(20)] + [(20, "short one"), (21, None), (22, ""), (None, text(30)), (23, "...")]
    items.append((24, items[3][1].upper()))  # an equal item under another id
    parts = items[0][1].split()
    docs = {
        1: f"{text(50)} {items[0][1]} {text(20)}",
        2: " ".join(parts[30:] + ["x"] + parts[15:30] + ["y"] + parts[:15]),  # rearranged
        3: ", ".join(items[3][1].title().split()),  # case and punctuation
        4: " ".join(parts[:12] + [word()] + parts[24:]),  # more than half of it
        5: f"{text(30)} {' '.join(parts[:15])} {text(30)}",  # less than half of it
        6: text(200), 7: None, 8: "", 9: "a short, one b", 10: "short and one", 11: items[23][1], 12: text(40_000) + " " + items[5][1],
    }
    rows = [(i, t, "item") for i, t in docs.items()] + [(1, docs[1], "item"), (None, items[7][1], "item")]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, item string"),
        spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("n", F.lit(1)),
    )


def test_planted_passages(planted):
    docs, items = planted
    got = {(r.doc_id, r.item_id) for r in decontam.tilings(docs, items).collect()}
    assert got == {(1, 0), (2, 0), (3, 3), (3, 24), (4, 0), (9, 20), (11, None), (12, 5), (None, 7)}
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 10]


def test_every_pair_is_looked_at(spark, planted):
    """Equal to tiling all pairs, with a Bloom filter so small that it is full too."""
    docs, items = planted
    rows, own = docs.distinct().collect(), items.select("item_id", "text").distinct().collect()
    want = set()
    for d in rows:
        for i in own:
            goal = decontam.tokens(i.text or "")
            covered = sum(n for *_, n in decontam.tile(goal, decontam.tokens(d.text or ""))) if goal else 0
            if goal and covered >= 0.5 * len(goal):
                want.add((d.doc_id, i.item_id, covered))
    for bits in (decontam.BLOOM_BITS_LOG2, (6, 6)):
        old, decontam.BLOOM_BITS_LOG2 = decontam.BLOOM_BITS_LOG2, bits
        got = {(r.doc_id, r.item_id, r.covered_tokens) for r in decontam.tilings(docs, items).collect()}
        decontam.BLOOM_BITS_LOG2 = old
        assert got == want


def test_empty_tables(planted):
    docs, items = planted
    assert decontam.tilings(docs.limit(0), items).count() == 0
    assert decontam.tilings(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    rnd = random.Random(3)
    texts = ["", " \n", "a", "A b", "a b c", "A É b\x0bc  d\n", "x y z " * 5, "w" * 90_000, "a b c d " * 20_000]
    texts += [" ".join(rnd.choice(["a", "B", "é", "dd\t"]) for _ in range(rnd.randint(0, 60))) for _ in range(100)]
    for t in texts[:-1]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def groups(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return out.values()


@pytest.mark.parametrize("tree_nodes", [1000, 3, 1])
def test_links_are_exact(spark, tree_nodes):
    rnd = random.Random(4)
    values = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 25])):
            v = base
            for _ in range(rnd.randint(0, 3)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {}
    for r in components.connected_components(simhash.fingerprint_links(prints, tree_nodes)).collect():
        found.setdefault(r.root, set()).add(r.node)
    want = groups(sorted(values), lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(map(sorted, found.values())) == sorted(sorted(map(signed, w)) for w in want if len(w) > 1)
    assert all(min(nodes) == root for root, nodes in found.items())


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionAll(spark.createDataFrame([(900, 901), (901, 901), (7, 3)], "a long, b long"))
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_near_duplicates(docs_of):
    long = " ".join(f"w{i * i % 1009}" for i in range(800))
    rows = [(5, long), (3, long + " end"), (9, long), (4, "quite another text with words of its own"), (7, None), (6, ""), (8, " \t"), (9, long), (None, "lonely null id text")]
    docs = docs_of(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "fp")
    got = simhash.near_duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert {i: r.component_id for i, r in by_id.items()} == {5: 3, 3: 3, 9: 3, 4: 4, 7: 6, 6: 6, 8: 6, None: None}
    assert by_id[7].fingerprint == "0" * 16 and by_id[5].fingerprint == f"{slow_fingerprint(long):016x}"
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 6]
    assert simhash.near_duplicate_groups(docs_of([])).count() == 0
    assert simhash.drop_near_duplicates(docs_of([(1, "a"), (1, "a")])).count() == 1


def test_unrelated_texts_without_id_or_under_one_id_stay(docs_of):
    rows = [(None, "quite some words that stand alone"), (None, "and another text of its own"), (4, "here is a third one too"), (4, "which shares an id with this"), (4, "which shares an id with this")]
    assert sorted(r.text for r in simhash.drop_near_duplicates(docs_of(rows)).collect()) == sorted({t for _, t in rows})
