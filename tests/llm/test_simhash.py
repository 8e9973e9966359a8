"""SimHash classes against brute force, the pigeonhole search on hot groups, and groups of near copies."""

import random

import xxhash

from millrace.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_classes(rows):
    prints = {}
    for key, text in rows:
        prints.setdefault(plain_print(text), []).append(key)
    values = sorted(prints)
    near = [(a, b) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 2]
    top = roots(values, near)
    least = {}
    for value in values:
        for key in prints[value]:
            if key is not None:
                least[top[value]] = min(least.get(top[value], key), key)
    return sorted(((key, f"{v:016x}", least.get(top[v])) for v in values for key in prints[v]), key=repr)


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query(spark):
    from millrace.llm.queries import op4_simhash

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(op4_simhash(spark, SF)) == plain_classes(docs)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  b"), (None, "a b"), (6, "x" * 100_000), (7, "a b c d e f"), (7, "a b c d e f")]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, root int")
    assert as_rows(simhash.classes(docs)) == plain_classes(rows)
    assert simhash.classes(docs.limit(0)).collect() == []


def test_crowded_prints_lose_no_link(spark):
    """Fingerprints around a few centres crowd the partitions; every component is found whichever way they are met."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(250)} | set(centres)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    ones = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    whole = roots(signed, ones)
    for crowd in (0, 8, 64, 10_000):
        found = [(r["a"], r["b"]) for r in simhash.linked(prints, crowd=crowd).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
        assert roots(signed, found) == whole


def test_thresholds_add_up():
    import numpy as np

    counts = np.array([[0, 0, 0], [500, 0, 500], [0, 900, 900]])
    levels, _ = simhash.allocation(counts, [22, 21, 21], 1000, 2)
    assert (levels.sum(axis=1) == 0).all()
    assert levels[0].tolist() == [0, 0, 0]
    assert levels[1][0] == -1 or levels[1][2] == -1


def near(text, edits, rng):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def test_one_of_each_group_stays(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    first, second, clean = fresh(300), fresh(200), [fresh(150) for _ in range(40)]
    rows = [(10, first), (11, first), (12, near(first, 3, rng)), (13, near(first, 4, rng)), (20, second), (21, near(second, 2, rng))]
    rows += [(100 + k, text) for k, text in enumerate(clean)] + [(5, None), (6, ""), (None, first)]
    rows += [(200 + k, near(first, 2, rng)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, _root string")
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [5, 10, 20, *range(100, 140)]
    assert simhash.without_copies(docs.limit(0)).collect() == []


def test_groups_are_near(spark):
    """No document joins a group without a member at the least similarity."""
    rng = random.Random(4)
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(1, base), (2, near(base, 25, rng)), (3, near(base, 1, rng))]
    found = {r["_id"]: r["_root"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 3: 1}


def plain_groups(rows, similarity=0.8):
    sets = {key: set(simhash.shingles(text, 5)) for key, text in rows}
    keys = sorted(sets)
    links = [(a, b) for k, a in enumerate(keys) for b in keys[:k] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    whole = roots(keys, links)
    many = {r: sum(x == r for x in whole.values()) for r in set(whole.values())}
    return {key: root for key, root in whole.items() if many[root] > 1}


def templated(groups, rng):
    """Documents of which a third share a long template, and pairs at every similarity down to 0.8 among them."""
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    template, rows, key = fresh(170), [], 0
    for k in range(groups):
        words = (template + fresh((22, 30, 40)[k % 9 // 3])) if k % 3 == 0 else fresh(120)
        rows.append((key, " ".join(words)))
        for width in (4, 8, 13):  # a run of changed words: similarity falls with its length
            at = rng.randrange(len(words) - width)
            rows.append((key + 1 + width, " ".join(words[:at] + fresh(width) + words[at + width :])))
        key += 100
    return rows


def test_every_near_pair_is_found_among_bystanders(spark):
    """Recall is whole at two sizes, also for pairs that are neither first nor last among those that share a template."""
    for groups in (30, 90):
        rows = templated(groups, random.Random(groups))
        expected = plain_groups(rows)
        found = {r["_id"]: r["_root"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == expected and len(expected) > groups


def test_unlike_texts_under_one_key_are_all_kept(spark):
    """None of them is dropped for sharing a key; rows that repeat a key and its text are one."""
    one = " ".join(f"a{k}" for k in range(40))
    two = " ".join(f"b{k}" for k in range(40))
    rows = [(1, one, "x"), (1, two, "y"), (1, one, "z"), (2, two + " c", "x"), (3, two + " c", "x"), (3, two + " c", "x"), (4, None, "n"), (4, "", "n"), (None, one, "x"), (None, one, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("1", one), ("1", two), ("2", two + " c"), ("4", ""), ("None", one), ("None", one)])


def test_copies_go_by_linked_fingerprints(spark):
    """Texts whose fingerprints differ in two bits at most are one class in the pipeline, too, however unlike their sets are."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words) + " w0 w1 w2 w3" * 3), (3, " ".join(words[:40]) * 30)]
    rows += [(10 + k, " ".join(f"v{rng.randrange(10**7)}" for _ in range(30))) for k in range(20)]
    # One sentence over and over outweighs what surrounds it: the same majority of bits, unlike sets.
    chorus = " ".join(f"c{k}" for k in range(5))
    rows += [(50 + k, " ".join([chorus] * 400) + " " + " ".join(f"u{k}x{n}" for n in range(60))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.classes(docs).collect()}
    assert found[51] == 50
    assert not {r["_id"] for r in simhash.near_groups(docs).collect()} & {50, 51}
    kept = {r["doc_id"] for r in simhash.without_copies(docs).collect()}
    assert 50 in kept and 51 not in kept
    assert all(found[key] == key for key in kept)


def test_keys_alone_stay_on_disk_and_python_works_once(spark, monkeypatch, left):
    """What near-dedup leaves on disk are keys, no texts; prefixes are worked out in one pass of Python."""
    fresh = random.Random(4)
    rows = [(k, " ".join(f"w{fresh.randrange(10**6)}" for _ in range(30))) for k in range(20)]
    rows += [(30, rows[3][1]), (31, rows[4][1] + " more"), (32, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passes, settle = {}, simhash.settle

    def noted(frame, name):
        passes[name] = frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        return settle(frame, name)

    monkeypatch.setattr(simhash, "settle", noted)
    kept = simhash.without_copies(docs)
    assert passes["near-prefixes"] == 1
    assert left() == ["near-gone", "near-linked", "near-shared-keys"]
    assert sorted(map(tuple, kept.collect())) == sorted([*rows[:20], (32, "")])


def test_sets_are_made_without_shuffling_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"a b c d e f{k} a b c d e") for k in range(50)], "_id long, _text string")
    needed = texts.where("_id % 10 = 3").select("_id")
    sets = simhash.sets_of(texts, needed, 3)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    found = {r["_id"]: r["_set"] for r in sets.collect()}
    assert {3, 13, 23, 33, 43} <= set(found) and len(found) < 50
    assert all(found[k] == simhash.hashed(f"a b c d e f{k} a b c d e", 3).tolist() for k in found)
    monkeypatch.setattr(simhash, "NEEDED", 64)  # many keys to a bit
    assert {3, 13, 23, 33, 43} <= {r["_id"] for r in simhash.sets_of(texts, needed, 3).collect()}
    assert simhash.sets_of(texts, needed.limit(0), 3).collect() == []


def test_pairs_that_share_too_few_shingles_are_not_compared(spark, monkeypatch):
    """Two texts with a passage in common meet under it, but only those that share enough of their first shingles go on."""
    fresh = random.Random(6)
    words = lambda n: " ".join(f"w{fresh.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(0, 300, 2):
        passage = words(6)
        rows += [(k, f"{words(10)} {passage} {words(10)}"), (k + 1, f"{words(10)} {passage} {words(10)}")]
    rows += [(400, " ".join([rows[0][1], "more"])), (401, " ".join([rows[1][1], "more"]))]
    counts, settle = {}, simhash.settle

    def noted(frame, name):
        out = settle(frame, name)
        counts[name] = out.count() if name.endswith("candidates") else 0
        return out

    monkeypatch.setattr(simhash, "settle", noted)
    groups = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["_id"], r["_root"]) for r in groups.collect()} == {(0, 0), (400, 0), (1, 1), (401, 1)}
    assert counts["near-rest-candidates"] == 0
