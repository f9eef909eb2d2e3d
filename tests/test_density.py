import random

import pandas as pd
import pytest

from mutprox.operators import density, forest

EDGES = "structure string, key1 string, key2 string, distance double"


def run(rows, eps=10.0, min_pts=3.0, site=()):
    """``_optics`` over edges of weight 1, as a list of (key, rd)."""
    cols = ["kind", "key1", "key2", "distance", "w1", "w2"]
    table = [("edge", a, b, d, 1.0, 1.0) for a, b, d in rows] + [("site", a, b, None, None, None) for a, b in site]
    found = density._optics(pd.DataFrame(table, columns=cols).assign(run=0, structure="s", component="k0"), eps, min_pts, 1)
    return list(zip(found["key"], found["rd"]))


def test_same_site_goes_before_a_core_and_a_core_before_the_smallest_key():
    # every vertex reaches every other at its core distance of 1, but for the last two, which are no cores
    keys = [f"k{i}" for i in range(6)]
    rows = [(a, b, 1.0) for a in keys for b in keys if a < b] + [("k0", "b0", 1.0), ("k0", "b1", 1.0)]
    plain = run(rows, min_pts=4.0)
    tail = [k for k, _ in plain if k.startswith("b")]
    assert tail == ["b0", "b1"] and [k for k, _ in plain][-2:] == tail  # borders after the cores
    first = plain[0][0]
    other = max(k for k in keys if k != first)
    order = [k for k, _ in run(rows, min_pts=4.0, site=[tuple(sorted((first, other)))])]
    assert order[:2] == [first, other]
    after_k0 = run(rows, min_pts=4.0, site=[("b1", "k0")])
    at = [k for k, _ in after_k0].index("k0")
    assert after_k0[at + 1][0] == "b1"  # even a border goes before cores


def brute(rows, keys, eps, min_pts, order):
    """Reachability of each vertex, in the given order, from the definition."""
    dist = {}
    for a, b, d in rows:
        if d <= eps:
            dist[a, b] = dist[b, a] = min(d, dist.get((a, b), d))
    core = {}
    for k in keys:
        near = sorted(d for (a, _), d in dist.items() if a == k)
        total, at = 1.0, 0.0
        for d in near:
            if total >= min_pts:
                break
            total, at = total + 1, d
        if total >= min_pts:
            core[k] = at
    out, done = {}, []
    for k in order:
        reach = [max(core[p], dist[p, k]) for p in done if p in core and (p, k) in dist]
        out[k] = min(reach, default=eps)
        done.append(k)
    return out, core, dist


@pytest.mark.parametrize("n", [50, 120, 200])
def test_order_follows_the_definition(n):
    rng = random.Random(n)
    keys = [f"k{i:03d}" for i in range(n)]
    pairs = {tuple(sorted(rng.sample(keys, 2))) for _ in range(2 * n)}
    rows = [(a, b, round(rng.uniform(0.5, 9.5), 1)) for a, b in sorted(pairs)]
    got = run(rows, min_pts=4.0)
    seen = [k for k, _ in got]
    assert len(seen) == len(set(seen)) == len({k for r in rows for k in r[:2]})
    want, core, dist = brute(rows, keys, 10.0, 4.0, seen)
    for at, (k, r) in enumerate(got):
        assert r == want[k]
        left = [min((max(core[p], dist[p, o]) for p in seen[:at] if p in core and (p, o) in dist), default=None) for o in seen[at:]]
        open_ = [x for x in left if x is not None]
        assert not open_ or r == min(open_)  # always the nearest of those in reach


def test_components_keep_the_islands_of_the_whole(spark):
    rng = random.Random(4)
    rows = []
    for c in range(5):
        keys = [f"c{c}k{i}" for i in range(12)]
        rows += [("s", a, b, round(rng.uniform(0.5, 9.5), 2)) for a in keys for b in keys if a < b and rng.random() < 0.5]
    rows.append(("s", "far1", "far2", 15.0))
    edges = spark.createDataFrame(rows, EDGES)
    keys = {k for r in rows for k in r[1:3]}
    weights = spark.createDataFrame([(k, 1.0) for k in sorted(keys)], "key string, weight double")
    order = density.optics_order(edges, weights, runs=2)
    got = order.collect()
    assert len(got) == 2 * len(keys) and {r["component"] for r in got if r["key"].startswith("far")} == {"far1", "far2"}
    assert all(r["rd"] == 10.0 for r in got if r["ord"] == 0)
    islands = density.reachability_islands(order, 10.0).filter("run = 0").collect()
    members = lambda i: {r["key"][:2] for r in got if r["run"] == 0 and r["component"] == i["component"] and i["first"] <= r["ord"] <= i["last"]}
    assert sorted(tuple(members(i)) for i in islands) == [(f"c{c}",) for c in range(5)]
    found = density.density_clusters(order)
    assert {r["component"] for r in found.collect()} == {i["component"] for i in islands}
    p = density.membership_probability(order, found, 4.0)
    top = {r["key"] for r in p.filter("level = 0 and hits = runs").collect()}
    assert len(top) > 50
    pairs = spark.createDataFrame([("c0k0", "else")], "key1 string, key2 string")
    wide = density.probable_clusters(p, pairs).collect()
    assert {r["component"] for r in wide if r["key"] == "else"} == {r["component"] for r in wide if r["key"] == "c0k0"}


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    order = density.optics_order(none, spark.createDataFrame([], "key string, weight double"), same_site=spark.createDataFrame([], "key1 string, key2 string"))
    assert order.count() == 0 and density.density_clusters(order).count() == 0


def brute_levels(rd, weight, eps=10.0, min_pts=4.0):
    """Super clusters and their levels by going over all bars at every cut."""
    heads = [k for k in range(len(rd)) if k == 0 or rd[k] >= eps]
    out, sup = [], -1
    for s, e in zip(heads, [h - 1 for h in heads[1:]] + [len(rd) - 1]):
        if sum(weight[s : e + 1]) < min_pts:
            continue
        sup += 1
        bars = sum(rd[s + 1 : e + 1])
        out.append((sup, 0, 0, s, e, 9.9, bars / sum(weight[s : e + 1]) if bars else 0.1, "0"))
        low = min(rd[s + 1 : e + 1], default=eps)
        top = (rd[e] if e - s >= 2 else eps) + 0.5
        known, level, i = None, 1, 0
        while low + 0.1 * i <= top:
            at = low + 0.1 * i
            bounds = [k for k in range(s, e + 1) if k == s or rd[k] >= at]
            now = []
            for a, z in zip(bounds, [b - 1 for b in bounds[1:]] + [e]):
                if sum(weight[a : z + 1]) >= min_pts and (z > a or i == 0):
                    now.append((a, z))
            if now:
                new = known is None or len(now) != len(known)
                old = [p for p in known or () if p[1] > p[0]]
                if not new and old:
                    for a, z in now:
                        if z > a:
                            met = [p for p in old if a <= p[0] and p[1] <= z]
                            new = new or not met or any(z - a >= 2 * (q - p) for p, q in met)
                if new:
                    for k, (a, z) in enumerate(now, 1):
                        w = sum(weight[a + 1 : z + 1])
                        density = sum(r * x for r, x in zip(rd[a + 1 : z + 1], weight[a + 1 : z + 1])) / w if z > a else 0.1
                        covers = "1" if level == 1 else ":".join(f"{sup}.{level - 1}.{m}" for m, (p, q) in enumerate(known, 1) if a <= p and q <= z) or "2"
                        out.append((sup, level, k, a, z, at, density, covers))
                    known, level = now, level + 1
            i += 1
    return out


def orders():
    rng = random.Random(9)
    for n in (1, 2, 3, 7, 60, 150, 200):
        for spread in (0.2, 9.0):
            rd = [10.0] + [10.0 if rng.random() < 0.06 else round(rng.uniform(1, 1 + spread), 1) for _ in range(n - 1)]
            yield rd, [float(rng.choice([1, 1, 1, 2, 5])) for _ in rd]


def order_table(spark, found):
    rows = [(f"s{k}", 0, "c", i, f"k{i}", r, r, w) for k, (rd, weight) in enumerate(found) for i, (r, w) in enumerate(zip(rd, weight))]
    return spark.createDataFrame(rows, "structure string, run int, component string, ord long, key string, rd double, cd double, weight double")


def test_tree_of_an_order():
    for rd, _ in orders():
        up, until = density.tree_of(rd)
        for k, r in enumerate(rd):
            assert up[k] == max((j for j in range(k) if rd[j] > r), default=None)
            assert until[k] == min((j for j in range(k + 1, len(rd)) if rd[j] >= r), default=len(rd)) - 1


def test_levels_equal_a_sweep_over_all_bars(spark):
    found = list(orders())
    got = {}
    for r in density.density_clusters(order_table(spark, found)).collect():
        got.setdefault(r["structure"], []).append((r["super_id"], r["level"], r["sub_id"], r["first"], r["last"], round(r["cut"], 9), round(r["density"], 9), r["covering"]))
    levels = 0
    for k, (rd, weight) in enumerate(found):
        want = [(*x[:5], round(x[5], 9), round(x[6], 9), x[7]) for x in brute_levels(rd, weight)]
        assert sorted(got.get(f"s{k}", [])) == sorted(want)
        levels = max([levels, *(x[1] for x in want)])
    assert levels > 5


def brute_members(runs, base, min_pts=4.0, eps=10.0):
    """Hits of every vertex in the clusters of run 0; ``runs``: lists of (key, rd, weight), ``base``: clusters of run 0."""
    inside = {}
    for sup, level, sub, a, z, *_ in base:
        for k, _, _ in runs[0][a : z + 1]:
            inside.setdefault((sup, level), {})[k] = sub
    at = {(c[0], c[1]): eps if c[1] == 0 else c[5] for c in base}
    hits = {(sup, level, sub, k): 1 for (sup, level), m in inside.items() for k, sub in m.items()}

    def split(rows, bound):
        out = []
        for row in rows:
            if not out or row[1] >= bound:
                out.append([])
            out[-1].append(row)
        return out

    def matched(stretches, member):
        """For each target the stretch that goes to it and shares most with it."""
        best = {}
        for n, rows in enumerate(stretches):
            count = {}
            for k, _, _ in rows:
                if k in member:
                    count[member[k]] = count.get(member[k], 0) + 1
            if count:
                to = max(count, key=lambda x: (count[x], -x))
                if to not in best or count[to] > best[to][0]:
                    best[to] = (count[to], n)
        return {to: stretches[n] for to, (_, n) in best.items()}

    for rows in runs[1:]:
        supers = [x for x in split(rows, eps) if sum(r[2] for r in x) >= min_pts]
        member = {k: sup for (sup, level), m in inside.items() if level == 0 for k in m}
        for sup, own in matched(supers, member).items():
            for (s, level), bound in at.items():
                if s == sup:
                    heavy = [x for x in split(own, bound) if sum(r[2] for r in x) >= min_pts and (len(x) > 1 or level == 1)]
                    for sub, x in matched(heavy, inside[sup, level]).items():
                        for k, _, _ in x:
                            hits[sup, level, sub, k] = hits.get((sup, level, sub, k), 0) + 1
    return hits


def test_probabilities_equal_counting(spark):
    rng = random.Random(12)
    runs = []
    for _ in range(5):
        keys = [f"k{i:02d}" for i in range(60)]
        for _ in range(12):
            a, b = rng.randrange(60), rng.randrange(60)
            keys[a], keys[b] = keys[b], keys[a]
        runs.append([(k, 10.0 if i == 0 or rng.random() < 0.05 else round(1 + (i * 7 % 40) / 5 + rng.random(), 1), 1.0 + (i % 9 == 0) * 4) for i, k in enumerate(keys)])
    rows = [("s", r, "c", i, k, rd, rd, w) for r, own in enumerate(runs) for i, (k, rd, w) in enumerate(own)]
    order = spark.createDataFrame(rows, "structure string, run int, component string, ord long, key string, rd double, cd double, weight double")
    base = brute_levels([x[1] for x in runs[0]], [x[2] for x in runs[0]])
    want = brute_members(runs, base)
    p = density.membership_probability(order, density.density_clusters(order)).collect()
    assert {(r["super_id"], r["level"], r["sub_id"], r["key"]): r["hits"] for r in p} == want
    assert all(r["runs"] == 5 and abs(r["probability"] - r["hits"] / 5) < 1e-12 for r in p)
    assert len({c[1] for c in base}) > 2 and len(set(want.values())) > 3
    pairs = [("k01", "x1"), ("k01", "x2"), ("y1", "k40")]
    table = spark.createDataFrame([(r["structure"], r["component"], r["super_id"], r["level"], r["sub_id"], r["key"], r["hits"], r["runs"]) for r in p], "structure string, component string, super_id int, level int, sub_id int, key string, hits long, runs long")
    got = {(r["super_id"], r["level"], r["sub_id"], r["key"]) for r in density.probable_clusters(table, spark.createDataFrame(pairs, "key1 string, key2 string"), 60.0).collect()}
    kept = {k for k, n in want.items() if n * 100 >= 60 * 5}
    other = {}
    for a, b in pairs:
        other.setdefault(a, []).append(b)
        other.setdefault(b, []).append(a)
    assert got == kept | {(*k[:3], o) for k in kept for o in other.get(k[3], [])}
    assert len(got) > len(kept) > 0 and len(kept) < len(want)


def partition(rows, at, cores):
    """Cores that are cores at this cut, parted by the islands of an order of (key, rd)."""
    groups, now = [], None
    for k, r in rows:
        if now is None or r >= at:
            groups.append(now := set())
        if k in cores and cores[k] < at:
            now.add(k)
    return sorted(sorted(g) for g in groups if g)


@pytest.mark.parametrize("n", [60, 200])
def test_forest_order_has_the_islands_of_the_walk(spark, n):
    rng = random.Random(n)
    keys = [f"k{i:03d}" for i in range(n)]
    pairs = sorted({tuple(sorted(rng.sample(keys, 2))) for _ in range(2 * n)})
    # distances on a coarse grid, so that many are equal
    rows = [("s", a, b, round(rng.uniform(0.5, 9.5) * 2) / 2) for a, b in pairs] + [("t", a, b, rng.uniform(0.5, 9.5)) for a, b in pairs] + [("t", "far1", "far2", 12.0)]
    edges = spark.createDataFrame(rows, EDGES)
    weights = spark.createDataFrame([(k, 1.0) for k in [*keys, "far1", "far2"]], "key string, weight double")
    found = {}
    for fits in (0, 10**6):
        for r in sorted(density.optics_order(edges, weights, runs=2, fits=fits).collect(), key=lambda r: r["ord"]):
            found.setdefault((fits, r["structure"], r["run"]), {}).setdefault(r["component"], []).append(r)
    seen = {}
    for s in "st":
        dist = {k: d for st, a, b, d in rows if st == s and d <= 10 for k in ((a, b), (b, a))}
        cores = {r["key"]: r["cd"] for own in found[10**6, s, 0].values() for r in own if r["cd"] < 10 or r["rd"] < 10}
        _, cores, _ = brute([(a, b, d) for st, a, b, d in rows if st == s], sorted({k for st, a, b, _ in rows if st == s for k in (a, b)}), 10.0, 4.0, [])
        for run in (0, 1):
            walk, tree = found[10**6, s, run], found[0, s, run]
            assert walk.keys() == tree.keys()
            for c in walk:
                assert sorted(r["key"] for r in walk[c]) == sorted(r["key"] for r in tree[c])
                for own in (walk[c], tree[c]):
                    rd = [r["rd"] for r in own]
                    assert [r["ord"] for r in own] == list(range(len(own))) and rd[0] == 10.0
                    up, until = density.tree_of(rd)
                    assert [r["up"] for r in own] == up and [r["until"] for r in own] == until
                for at in sorted({r["rd"] for r in walk[c]} | {10.0, 3.33}):
                    assert partition([(r["key"], r["rd"]) for r in tree[c]], at, cores) == partition([(r["key"], r["rd"]) for r in walk[c]], at, cores)
            seen[s, run] = [r["key"] for c in sorted(tree) for r in tree[c]]
        assert seen[s, 0] != seen[s, 1]  # another shuffle
        assert len(cores) > n / 4 and dist


def test_super_clusters_are_cut_in_batches(spark):
    """One call takes a batch of super clusters, and an order of more than a batch has the levels of all its bars."""
    rows = lambda k, at: [("s", 0, "c", k, at, at + 3, 0, 2, 1.5, 1.0), ("s", 0, "c", k, at + 1, at + 1, 0, 0, 0.1, 1.0), ("s", 0, "c", k, at, at + 9, 3, 5, 2.5, 1.0)]
    cols = ["structure", "run", "component", "super_id", "first", "last", "lo", "hi", "density", "low"]
    one, two = (density._all_levels(pd.DataFrame(x, columns=cols)) for x in (rows(0, 10), rows(1, 50)))
    both = density._all_levels(pd.DataFrame(rows(1, 50) + rows(0, 10), columns=cols))
    assert len(one) and both.equals(pd.concat([one, two], ignore_index=True))
    rng = random.Random(2)
    n = 3 * density.BATCH
    rd = [x for _ in range(n) for x in (10.0, *(round(rng.uniform(1, 4), 1) for _ in range(rng.randrange(6))))]
    weight = [float(rng.choice([1, 1, 2, 5])) for _ in rd]
    got = [(r["super_id"], r["level"], r["sub_id"], r["first"], r["last"], round(r["cut"], 9), round(r["density"], 9), r["covering"]) for r in density.density_clusters(order_table(spark, [(rd, weight)])).collect()]
    want = [(*x[:5], round(x[5], 9), round(x[6], 9), x[7]) for x in brute_levels(rd, weight)]
    assert max(x[0] for x in want) > density.BATCH and sorted(got) == sorted(want)


def near_places(n, seed):
    """Edges of up to 10 between random places, of two structures: any distances, and many that are equal."""
    rng = random.Random(seed)
    rows = []
    for s, step, wide in (("s", None, 25), ("t", 2, 30)):
        at = [tuple(rng.uniform(0, wide) for _ in range(3)) for _ in range(n)]
        for i in range(n):
            for j in range(i):
                d = sum((x - y) ** 2 for x, y in zip(at[i], at[j])) ** 0.5
                d = d if step is None else max(1.0, round(d / step) * step)
                if d <= 10:
                    rows.append((s, f"k{j:03d}", f"k{i:03d}", float(d)))
    return [*rows, ("s", "far1", "far2", 12.0), rows[0]]


def test_order_and_clusters_do_not_depend_on_the_size(spark):
    """Components on either side of ``fits`` get one order to the last bar, with equal distances, borders, sites and broken weights."""
    n, rng = 80, random.Random(8)
    edges = spark.createDataFrame(near_places(n, 8), EDGES)
    weights = spark.createDataFrame([(f"k{i:03d}", rng.choice([0.1, 0.3, 0.7, 1.0])) for i in range(n)] + [("far1", 1.0), ("far2", 5.0)], "key string, weight double")
    site = spark.createDataFrame([(f"k{i:03d}", f"k{rng.randrange(n):03d}") for i in range(n)], "key1 string, key2 string")
    found = []
    for fits in (10**6, 0):
        order = density.optics_order(edges, weights, runs=2, same_site=site, fits=fits)
        order = spark.createDataFrame(order.collect(), order.schema)
        found.append((sorted(map(str, order.collect())), sorted(map(str, density.density_clusters(order).collect()))))
    assert found[0] == found[1] and len(found[0][0]) == 2 * (2 * n + 2) and len(found[0][1]) > 10


@pytest.mark.parametrize("block", [100, 10**6])
def test_thinned_edges_have_the_order_of_all(spark, block):
    n = 150
    rows = [r[1:] for r in near_places(n, 3) if r[0] == "s" and not r[1].startswith("far")] + [("k001", "k001", 3.0)]
    number = lambda k: int(k[1:])
    edges = spark.createDataFrame([(number(a), number(b), d) for a, b, d in rows], "v1 long, v2 long, distance double")
    _, core, _ = brute(rows, sorted({k for r in rows for k in r[:2]}), 10.0, 4.0, [])
    cores = spark.createDataFrame([(number(k), d) for k, d in core.items()], "v long, core_distance double")
    left = [(f"k{r['v1']:03d}", f"k{r['v2']:03d}", r["distance"]) for r in forest.walkable(edges, cores, block).collect()]
    assert len(left) < len(rows) / 2 and set(left) < set(rows)
    assert run(left, min_pts=4.0) == run(rows, min_pts=4.0)
