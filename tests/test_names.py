import random

from mutprox.operators import genes
from mutprox.operators.ranges import join_overlaps


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)

    def side(n):
        return [(i, rng.choice("ab"), a := rng.randrange(-300, 300), a + rng.choice((0, 1, 7, 64, 300, -2))) for i in range(n)] + [(n, None, 1, 2), (n + 1, "a", None, 5), (n + 2, "b", 5, None)]

    left, right = side(120), side(90)
    one = spark.createDataFrame(left, "i int, k string, a int, b int")
    two = spark.createDataFrame(right, "j int, k string, c long, d long")
    whole = lambda x: None not in x[1:] and x[2] <= x[3]
    want = sorted((x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    got = join_overlaps(one, two, ["k"], ("a", "b"), ("c", "d"))
    assert got.columns == ["k", "i", "a", "b", "j", "c", "d"]
    assert sorted((r["i"], r["j"]) for r in got.filter("a <= b and c <= d").collect()) == want


def test_symbols_equal_all_pairs(spark):
    """Few ids, many repeats, places that are missing, records without previous symbols."""
    rng = random.Random(9)
    some = lambda n: rng.choice([None, *(str(x) for x in range(n))])
    ids = lambda: [some(4), None, None, some(3), some(3), None, None]

    def place():
        a = rng.randrange(900_000)
        return rng.choice([(None, 5), (a, None), (a, a + 400), (a + 300, a), (a, a + 90_000)])

    bad = [(f"O{rng.randrange(30)}", rng.choice(("chr1", "2", None)), *place(), *ids()) for _ in range(60)] + [(None, "1", 1, 2, *ids())]
    names = lambda: rng.choice([None, [], [f"O{rng.randrange(30)}", f"O{rng.randrange(30)}"]])
    cur = [(f"S{rng.randrange(70)}", rng.choice(("1q2", "2p1", "X")), *place(), names(), names(), *ids()) for _ in range(80)]
    kinds = ", ".join(f"{k} string" for k in genes.IDS)
    want = []
    for s, c, a, b, *x in bad:
        for t, d, e, f, prev, also, *y in cur:
            hit = sum((1 + (k == genes.TWICE)) * (p is not None and p == q) for k, p, q in zip(genes.IDS, x, y))
            miss = sum(p is not None and q is not None and p != q for p, q in zip(x, y))
            known = None not in (a, b, e, f)
            near = not known or (max(e, f) + 100_000 > min(a, b) and min(e, f) - 100_000 < max(a, b))
            named = s in (prev or []) or s in (also or [])
            if s is None or c is None or c.replace("chr", "") != d[0] or not near:
                continue
            if named and (miss <= 1 or hit > 0):
                want.append((s, t, "name"))
            elif hit > 1 and miss == 0:
                want.append((s, t, "ids"))
            elif 0 < hit <= 1 and miss <= 1:
                want.append((s, t, "id"))
    invalid = spark.createDataFrame(bad, f"symbol string, chromosome string, start int, stop int, {kinds}")
    current = spark.createDataFrame(cur, f"symbol string, chromosome string, start int, stop int, previous array<string>, aliases array<string>, {kinds}")
    assert {w[2] for w in want} == {"name", "ids", "id"}
    assert sorted(tuple(r) for r in genes.reconcile_symbols(invalid, current).collect()) == sorted(want)
