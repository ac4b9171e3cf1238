"""The pipeline's near copies against the exact similarity of all pairs."""

import itertools
import random

import pytest

from morphlake.llm import near_copies


def shingle_set(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(docs):
    """The least id of each group of what similarities of 0.8 and more connect."""
    sets, root = {d: shingle_set(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(d) for d in docs}


def made_texts():
    """Families of texts with 0 to 9 changed, added or missing words."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = ["", None, " \n", "one two", "ONE two", "one two three"]
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([5, 9, 20, 60, 200, 600]))
        texts.append(" ".join(base))
        for _ in range(5):
            near = list(base)
            for _ in range(rng.randint(0, 9) * max(1, len(base) // 200)):
                at = rng.randrange(len(near))
                near[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
                near = near or ["x"]
            texts.append(" ".join(near))
    return dict(enumerate(texts))


def test_near_copies_are_exact(spark, monkeypatch):
    docs = made_texts()
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = survivors(docs)
    assert 100 < len(want) < 300
    assert {r.doc_id for r in near_copies.drop_near_copies(table).collect()} == want
    # nothing is tried first: whole sets are compared
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: pairs.select("a", "b").limit(0))
    assert {r.doc_id for r in near_copies.drop_near_copies(table).collect()} == want


def chained_texts():
    """A chain in which only neighbours are near, and a family of boilerplate whose
    texts are close, but not close enough, but for some pairs."""
    rng = random.Random(3)
    words = [f"u{k}" for k in range(400)]
    chain = [" ".join(words[6 * k : 6 * k + 75]) for k in range(40)]
    plate = [f"p{k}" for k in range(60)]
    family = [" ".join(plate + [f"own{k}x{i}" for i in range(12)]) for k in range(60)]
    family += [t + " more" for t in rng.sample(family, 15)]
    texts = chain + family
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("piece, items, counters", [(4, 1 << 21, 1 << 18), (1024, 500, 1 << 18), (4, 1 << 21, 2)])
def test_groups_of_several_pieces(spark, monkeypatch, piece, items, counters):
    docs = chained_texts()
    want = survivors(docs)
    assert len(want) == 1 + 60
    monkeypatch.setattr(near_copies, "PIECE", piece)
    monkeypatch.setattr(near_copies, "PIECE_ITEMS", items)
    monkeypatch.setattr(near_copies, "COUNTERS", counters)
    cut, seen = near_copies._cut, []
    monkeypatch.setattr(near_copies, "_cut", lambda *a: seen.append(1) or cut(*a))
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_copies.drop_near_copies(table).collect()} == want
    assert seen


def test_linked_sets_share_a_rare_shingle():
    rng = random.Random(8)
    counts = near_copies.np.array([rng.randrange(50) for _ in range(near_copies.COUNTERS)])
    for _ in range(300):
        n = rng.choice([1, 2, 4, 5, 9, 10, 33, 200])
        one = [rng.getrandbits(62) for _ in range(n)]
        two = one[: len(one) - n // 9] + [rng.getrandbits(62) for _ in range(n // 9)]
        if 5 * len(set(one) & set(two)) < 4 * len(set(one) | set(two)):
            continue
        rows = near_copies.pa.RecordBatch.from_pylist([{"whole": 0, "own": k, "items": sorted(x)} for k, x in enumerate((one, two))])
        (made,) = near_copies._rare(counts)([rows])
        rare = [{r["item"] for r in made.to_pylist() if r["own"] == k} for k in (0, 1)]
        assert rare[0] & rare[1] and len(rare[0]) == n - -(-4 * n // 5) + 1


def test_bands_miss_no_pair_at_the_limit():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.choice([8, 32, 200])
        whole = near_copies.np.array([rng.getrandbits(64) for _ in range(n + n // 4)], near_copies.np.uint64)
        assert set(near_copies.bands(near_copies.np.sort(whole[:n]))) & set(near_copies.bands(near_copies.np.sort(whole)))
    assert near_copies.bands(near_copies.shingles("")) == []


def test_one_row_of_a_group_stays_where_ids_repeat(spark):
    """Near texts under one id, without ids, and with ids beside them."""
    near = [" ".join([*(f"w{k}" for k in range(60)), f"x{n}"]) for n in range(4)]
    other = [t.replace("w", "v") for t in near]
    third = [t.replace("w", "u") for t in near]
    rows = [(7, t) for t in near] + [(None, t) for t in other] + [(9, third[0]), (None, third[1]), (9, third[2]), (3, third[3])] + [(7, near[0]), (7, "alone")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in kept) == [(0, "v0"), (3, "u0"), (7, "alone"), (7, "w0")]
